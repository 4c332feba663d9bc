"""How far the sources of a language differ in their words: symmetric divergence of every pair, and each source's own terms.

One pass over the texts counts terms by language and source, and documents by term. A kept term's counts in its language's
sources are a sparse vector, a list of (source, count); terms with the same vector are one row with a multiplicity, many
where terms are rare. Each pair of sources is evaluated once for a distinct vector and the
value multiplied. Vectors are dealt out in chunks by language, each with the language's sources, and a task adds its chunk
up, so neither a language's vectors nor its terms meet in one task. A source's own terms are ranked on the original terms.

With count c of a kept term in a group, N the group's sum and V the kept terms, p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and a
term gives two groups floor((p - q)^2 / (p + q)). All arithmetic is on integers; the quotient is worked out three decimal
digits at a time, so nothing overflows below N of 9 * 10^15.

Defined results: null texts, languages and sources are empty ones; each row is a document, repeated ids and rows too;
languages without a kept term have pairs of value 0 and no terms; equal values rank by the item's bytes; an empty table
gives no rows; other columns are ignored. A term's vector holds at most one entry for each source of the language, and
the result has a row for each two of them, so a language's sources are taken to fit a task; its terms are not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import estimated_bytes, partitions, pieces, run_dir, written

SCALE = 10**9
MIN_DOCS, TOP = 10, 10
#: Entries of a task's table of counts before it is passed on.
HELD = 400_000
#: Cells (vectors x sources) that are evaluated at a time.
CELLS = 1 << 20

# Lower-cases A-Z; every byte that is no letter or part of a character above U+007F becomes a blank.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) summed by task; docs has text, lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for part in pieces(batches):
            for text, lang, source in zip(*(c.to_pylist() for c in part.columns)):
                n, of = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(of)
                words = text.encode().translate(_LOWER).split()
                n.update(words)
                of.update(set(words))
                size += len(of) - before
            if size > HELD:
                yield from _counted(held)
                held, size = {}, 0
        yield from _counted(held)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _counted(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, of) in held.items():
        if n:
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            counts = pa.array(list(n.values()), pa.int64())
            many = pa.array([of[t] for t in n], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, counts, many], ["lang", "source", "term", "n", "docs"])


def scaled(count, total):
    """1 + floor(10^9 count / total) on columns or arrays of integers, count <= total."""
    div = (lambda a: F.call_function("div", a, total)) if isinstance(count, Column) else (lambda a: a // total)
    out, rest = 1, count
    for power in (10**6, 10**3, 1):
        whole = rest * 1000
        out = div(whole) * power + out
        rest = whole % total
    return out


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, vector (sorted (source, n)) of the terms that at least ``min_docs`` documents of the language hold."""
    by_source = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vector = F.sort_array(F.collect_list(F.struct("source", "n")))  # an entry for each source of the language at most
    return by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector.alias("vector")).where(F.col("docs") >= min_docs).select("lang", "term", "vector")


def groups(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, source, N (occurrences of kept terms) and V (kept terms of the language) of every group; vectors with their multiplicity."""
    n = vectors.select("lang", "m", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("x.n") * F.col("m")).alias("N"))
    v = vectors.groupBy("lang").agg(F.sum("m").alias("V"))
    return docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["N", "V"])


def pair_values(vectors: DataFrame, sources: DataFrame, chunks: int) -> DataFrame:
    """lang, a, b, value for each two sources of a language, a before b: the sum over all kept terms."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = right["source"].to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        place = {names[i]: k for k, i in enumerate(order)}
        total = (right["N"].to_numpy() + 2 * right["V"].to_numpy())[order]
        s = len(order)
        sums = np.zeros((s, s), np.int64)
        step = max(1, CELLS // max(1, s))
        for at in range(0, left.num_rows, step):
            part = left.slice(at, step).combine_chunks()
            lists = part["vector"].chunk(0)
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            entries = lists.flatten()
            cols = np.fromiter((place[x] for x in entries.field("source").to_pylist()), np.int64, len(rows))
            counts = np.zeros((len(lists), s), np.int64)
            counts[rows, cols] = entries.field("n").to_numpy()
            p = np.ascontiguousarray(scaled(counts + 2, total).T)
            m = part["m"].to_numpy()
            for i in range(s - 1):
                d = p[i + 1 :] - p[i]
                sums[i, i + 1 :] += (d * d // (p[i + 1 :] + p[i])) @ m
        a, b = np.triu_indices(s, 1)
        told = pa.array([names[i] for i in order], pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), told.take(pa.array(a)), told.take(pa.array(b)), pa.array(sums[a, b])], ["lang", "a", "b", "value"])

    # The first chunk of a language has its sources even if it has no vector.
    dealt = vectors.withColumn("chunk", F.pmod(F.xxhash64("vector"), F.lit(chunks)).cast("int"))
    used = dealt.select("lang", "chunk").union(sources.select("lang", F.lit(0))).distinct()
    beside = sources.join(used.select("lang", F.col("chunk").alias("chunk")), "lang")  # columns of their own
    keys = ["lang", "chunk"]
    part = dealt.groupBy(*keys).cogroup(beside.groupBy(*keys)).applyInArrow(run, "lang string, a string, b string, value long")
    return part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def own_terms(kept: DataFrame, sources: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms that a source uses more than its language does."""
    lang = sources.groupBy("lang").agg((F.sum("N") + 2 * F.max("V")).alias("of_lang"))
    all_n = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = kept.select("lang", F.col("term").alias("item"), all_n.alias("all"), F.explode("vector").alias("x")).select("lang", "item", "all", "x.source", "x.n")
    rows = rows.join(sources.select("lang", "source", (F.col("N") + 2 * F.col("V")).alias("of")), ["lang", "source"]).join(lang, "lang")
    rows = rows.withColumn("p", scaled(F.col("n") + 2, F.col("of"))).withColumn("q", scaled(F.col("all") + 2, F.col("of_lang"))).where("p > q")
    rows = rows.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return _ranked(rows).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    ``pair``: the other sources of the language by their divergence. ``term``: the ``top`` terms that set a source apart
    from its language. The kept terms with their counts are written to the shared folder and read three times.
    """
    spark, empty = docs.sparkSession, F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    at = run_dir(spark, "divergence")
    kept = written(vocabulary(rows, min_docs), f"{at}/kept")
    vectors = written(kept.groupBy("lang", "vector").agg(F.count("*").alias("m")), f"{at}/vectors")
    sources = written(groups(rows, vectors), f"{at}/groups")
    pairs = pair_values(vectors, sources, partitions(spark, estimated_bytes(vectors), 4 << 20))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = _ranked(pairs.select("lang", "value", F.explode(both).alias("x")).select("lang", "x.source", "x.item", "value"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(own_terms(kept, sources, top).withColumn("part", F.lit("term")).select(*names))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents' sources by language: divergences of pairs, and the terms that set a source apart."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
