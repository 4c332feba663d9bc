"""Cleaning of a corpus in stages; each stage's rows are written as Parquet and reread as the next one's input.

Each stage works on all that the one before kept, whole texts, and keeps what it has no reason to drop:

1. quality classifier: documents that it rejects (score below 0.7) go;
2. n-gram Jaccard join: of each group of near copies the document with the smallest id stays;
3. suffix-array dedup: passages of 50 bytes or more that a smaller id also has are cut out of the text;
4. benchmark decontamination: documents that hold a benchmark passage go;
5. SentencePiece encoding and decoding: the documents' token ids, and whether they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.llm import decontaminate, jaccard_join, pu_quality, suffix_dedup, unigram
from lumenspan.llm.util import id_and_text, run_dir, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts. A null text is judged as an empty one, repeated rows are judged
    alike, an empty table gives no rows."""
    model = pu_quality.train(id_and_text(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.keep(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component keep the document with the smallest id, once if its row repeats; rows without an id stay.

    A null or empty text is linked with nothing, so its row stays; an empty table gives no rows.

    Only ids travel to be joined: the documents that go are few beside those that stay.
    """
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    stay = found.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    rows = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").select(*docs.columns)
    # Rows that repeat an id: the first by its text stays. Ids are nearly always different, so groups are small.
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*[c for c in docs.columns if c != "text"]))
    rank = "rank_of_id"
    while rank in docs.columns:
        rank += "_"
    rows = rows.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)
    return rows.unionByName(docs.where("doc_id IS NULL"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; n_chars is counted anew.

    A null text stays null; rows without an id, and rows that repeat one, take nothing from each other; an empty table
    gives no rows.
    """
    out = suffix_dedup.remove_repeats(docs, kept="text").select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match a benchmark item go; null and empty texts match nothing, repeated rows match alike, an empty
    table gives no rows, and items without an id count too."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip, token_ids; a null text is encoded as an empty one, a null id
    stays null, each repeated row is encoded, an empty table gives no rows."""
    return unigram.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", encoded),
]
#: SQL can't express the classifier; tests hold each stage against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = run_dir(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{at}/{k}")
    return docs
