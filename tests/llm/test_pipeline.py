"""Each stage of the pipeline on its own input, against brute force."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lumenspan.llm.util import run_dir, written
from test_pairs import components_by_hand, removed_by_hand

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 260")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at, columns = run_dir(spark, "t"), docs.columns
    step = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        step.append(written(stage(spark, step[-1], SF), f"{at}/{k}"))
    assert all(s.columns == columns for s in step[:-1]) and len(pipeline.STAGES) == 5
    rows = [{r["doc_id"]: r for r in s.collect()} for s in step]
    wrong = [i for i in rows[0] if i in labels and (i in rows[1]) != (labels[i] == 1)]
    assert len(wrong) <= 2
    first = {c for _, _, c in components_by_hand([(r["doc_id"], r["text"]) for r in rows[1].values()])}
    assert set(rows[2]) == first
    want = {d: n - gone for d, n, gone, _, _ in removed_by_hand([(r["doc_id"], r["text"]) for r in rows[2].values()])}
    assert set(rows[3]) == set(rows[2]) and all(want[i] - 6 <= len(r["text"].encode()) <= want[i] and r["n_chars"] == len(r["text"]) for i, r in rows[3].items())
    leaked = {i for i, r in rows[3].items() if any(t in r["text"] for t in items)}
    assert not leaked & set(rows[4]) and len(rows[3]) - len(rows[4]) <= len(leaked) + 2
    assert set(rows[5]) == set(rows[4]) and all(r["round_trip"] for r in rows[5].values())


def test_stages_of_odd_tables(spark, odd, odd_rows, empty):
    keep = pipeline.near_copies(spark, odd, SF)
    assert keep.columns == odd.columns and not pipeline.near_copies(spark, empty, SF).collect()
    ids = Counter(r["doc_id"] for r in keep.collect())
    assert ids[None] == 2 and all(n == 1 for i, n in ids.items() if i is not None) and 1 not in ids and 2 not in ids
    assert pipeline.repeats(spark, odd, SF).columns == odd.columns and pipeline.repeats(spark, odd, SF).count() == len(odd_rows)
    assert pipeline.encoded(spark, odd, SF).count() == len(odd_rows)
    assert pipeline.quality(spark, odd, SF).columns == odd.columns
    assert pipeline.benchmark(spark, odd, SF).count() == len(odd_rows)
    for stage in (pipeline.quality, pipeline.repeats, pipeline.benchmark, pipeline.encoded):
        assert not stage(spark, empty, SF).collect()
    # A column named as the stage's own would be is kept.
    named = odd.withColumn("rank_of_id", F.lit(77))
    assert {r["rank_of_id"] for r in pipeline.near_copies(spark, named, SF).collect()} == {77}
