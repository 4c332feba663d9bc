"""Matching two transcripts' segments: patterns, fallback by text, statistics and the nested report.

Segments have the columns of schemas.SRT. Two transcripts are compared per ``file_id``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import may_reach, normalise, similarity, similarity_from, word_count
from ..shared import run_dir, written
from .intervals import overlap_ratio_join
from .names import private

ALMOST = 0.95
#: Where either side of a file has no more texts, its texts meet each other directly, BLOCK left ones in a task; the index is
#: for larger files.
FEW, BLOCK = 1024, 64


def _segments(df: DataFrame) -> DataFrame:
    return df.select("file_id", "ordinal", "index", F.col("start_time").alias("start"), F.col("end_time").alias("end"), "text", normalise(F.col("text")).alias("norm"))


def best_text_match(left: DataFrame, right: DataFrame, threshold: float = 0.85, similar: Callable[[Column, Column], Column] = similarity) -> DataFrame:
    """For each left segment the right one (same file) with the most similar text, at least ``threshold``; the first of ties.

    left and right come from ``_segments``. Pairs of files with over FEW texts on both sides come from an index of rare grams,
    see ``text_candidates``, which holds for the ratio of matched characters. Texts of smaller files meet each other, if their
    lengths allow the ratio; another measure than that compares all pairs of a file. Both sides are written once to the
    shared folder, as they are read several times.
    """
    path = run_dir(left.sparkSession, "texts")
    left, right = written(left, f"{path}/l"), written(right, f"{path}/r")
    if similar is similarity:
        many = lambda df: df.groupBy("file_id").count().where(F.col("count") > FEW).select("file_id")
        large = written(many(left).join(many(right), "file_id"), f"{path}/large")
        few, rest = ([df.join(large, "file_id", how).select(*df.columns) for df in (left, right)] for how in ("left_anti", "left_semi"))
        pairs = _met(*few, path).where(may_reach(F.col("l_norm"), F.col("r_norm"), threshold)).unionByName(text_candidates(*rest, threshold))
        like = similarity_from(F.col("l_norm"), F.col("r_norm"), threshold)
    else:
        pairs = _met(left, right, path)
        like = similar(F.col("l_norm"), F.col("r_norm"))
    pairs = pairs.withColumn("similarity", like).where(F.col("similarity") >= threshold)
    w = Window.partitionBy("l_file_id", "l_ordinal").orderBy(F.desc("similarity"), "r_ordinal")
    rank = private(pairs, "_k")
    return pairs.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def _met(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """All pairs of a file. Its left texts are dealt to blocks, and its right ones repeated for each, so a large file is many
    tasks' work."""
    n = F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")
    blocks = written(left.groupBy(F.col("file_id").alias("_file")).agg(n), f"{path}/blocks")
    l, r = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)).join(blocks, F.col(f"{p}_file_id") == F.col("_file")).drop("_file") for df, p in ((left, "l"), (right, "r")))  # noqa: E741
    l = l.withColumn("_block", F.pmod(F.hash("l_ordinal"), "_blocks")).drop("_blocks")  # noqa: E741
    r = r.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return l.join(r, (F.col("l_file_id") == F.col("r_file_id")) & (l["_block"] == r["_block"])).drop("_block")


def text_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a file (``l_`` and ``r_`` columns) whose texts may match in a ratio of ``threshold``; none of those that do is lost.

    A ratio t of two texts with S characters together means M >= t S / 2 matched characters in blocks, and a gap between two
    blocks holds an unmatched character, so there are at most 1 + S - 2 M blocks and the texts share M - (1 + S - 2 M) >=
    (1.5 t - 1) S - 1 character pairs, counted with repeats. Numbered character pairs are sorted by how rare they are in the
    file, and two texts that share as many meet in the first ones of both (prefix filter), the rarest. Texts so short that
    this asks for none meet by single characters, of which they share t S / 2. What meets is held against both bounds before
    any comparison. Empty texts match each other. Below 2/3 there is no bound by pairs; single characters are used alone.
    """
    slope = 1.5 * threshold - 1
    short = math.ceil(2 / slope) if slope > 0 else 1 << 30  # texts with so many characters together share a pair for certain
    of = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns), _grams(F.col("norm"), 1).alias(f"{p}_chars"), _grams(F.col("norm"), 2).alias(f"{p}_pairs"))
    a, b = of(left, "l"), of(right, "r")

    def tokens(df: DataFrame, p: str) -> DataFrame:
        """Each token that may stand in a prefix, with the file; the shared number holds for the shortest partner."""
        n = F.length(f"{p}_norm")
        least = F.ceil(n * threshold / (2 - threshold))  # the shortest text that can match has so many characters
        kinds = F.array(
            F.struct(F.lit("c").alias("kind"), F.when(n <= short, F.col(f"{p}_chars")).otherwise(F.array().cast("array<string>")).alias("all"), F.ceil(threshold * (n + least) / 2 - _EPS).alias("share")),
            F.struct(F.lit("p").alias("kind"), F.when(F.lit(slope > 0) & (slope * (n + F.floor(n * (2 - threshold) / threshold)) - 1 > 0), F.col(f"{p}_pairs")).otherwise(F.array().cast("array<string>")).alias("all"), F.ceil(slope * (n + least) - 1 - _EPS).alias("share")),
        )
        rows = df.select(F.col(f"{p}_file_id").alias("file_id"), F.col(f"{p}_ordinal").alias("ordinal"), F.inline(kinds))
        held = F.greatest(F.lit(1), F.col("share"))
        return rows.select("file_id", "ordinal", "kind", (F.size("all") - held + 1).alias("prefix"), F.explode("all").alias("token"))

    both = [tokens(a, "l"), tokens(b, "r")]
    often = both[0].unionByName(both[1]).groupBy("file_id", "kind", "token").agg(F.count("*").alias("often"))
    w = Window.partitionBy("file_id", "ordinal", "kind").orderBy("often", "token")
    first = lambda t: t.join(often, ["file_id", "kind", "token"]).withColumn("k", F.row_number().over(w)).where("k <= prefix").select("file_id", "kind", "token", "ordinal")
    met = first(both[0]).withColumnRenamed("ordinal", "l_ordinal").join(first(both[1]).withColumnRenamed("ordinal", "r_ordinal"), ["file_id", "kind", "token"])
    empty = lambda df, p: df.where(F.col(f"{p}_norm") == "").select(F.col(f"{p}_file_id").alias("file_id"), f"{p}_ordinal")
    found = met.select("file_id", "l_ordinal", "r_ordinal").unionByName(empty(a, "l").join(empty(b, "r"), "file_id")).distinct()
    out = found.join(a.withColumnRenamed("l_file_id", "file_id"), ["file_id", "l_ordinal"]).join(b.withColumnRenamed("r_file_id", "file_id"), ["file_id", "r_ordinal"])
    total = F.length("l_norm") + F.length("r_norm")
    chars, pairs = (F.size(F.array_intersect(f"l_{c}", f"r_{c}")) for c in ("chars", "pairs"))
    out = out.where(may_reach(F.col("l_norm"), F.col("r_norm"), threshold) & (chars >= threshold * total / 2 - _EPS) & (pairs >= slope * total - 1 - _EPS))
    return out.select(F.col("file_id").alias("l_file_id"), *(f"l_{c}" for c in left.columns if c != "file_id"), F.col("file_id").alias("r_file_id"), *(f"r_{c}" for c in right.columns if c != "file_id"))


_EPS = 1e-6


def _grams(text: Column, q: int) -> Column:
    """All q characters in a row; equal ones are numbered, so that sets of them are intersected with repeats."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            seen: Counter = Counter()
            out = []
            for k in range(len(t or "") - q + 1):
                g = t[k : k + q]
                out.append(f"{g}\0{seen[g]}")
                seen[g] += 1
            return out

        return texts.map(one)

    return run(text)


def classify_segments(left: DataFrame, right: DataFrame, bucket: float = 10.0, overlap: float = 0.2, text_threshold: float = 0.85, similar: Callable[[Column, Column], Column] = similarity) -> DataFrame:
    """file_id, pattern, left_index, left_list, right_index, right_list, similarity, time_diff_s, time_diff_ms.

    A left segment without an overlap is a ``timeline_mismatch`` with the best text match, else ``missing``. With one it
    is ``one_to_one``, or ``text_diff_only`` below 0.95. With several, the first whose text is nearly equal (above 0.95)
    makes it ``one_to_one`` with similarity 1 and only that one counts as matched; without such it is ``split``. A right
    segment that nothing matched is ``merged`` if several left ones overlap it. Matched means: by the segment's index.
    ``similar`` is the measure of two normalised texts. What is read several times is written once to the shared folder: the
    segments, the pairs that overlap, the best text matches and the left segments' classes.
    """
    path = run_dir(left.sparkSession, "segments")
    a, b = (written(_segments(df).drop("text"), f"{path}/{p}") for df, p in ((left, "l"), (right, "r")))
    pairs = overlap_ratio_join(a, b, ["file_id"], bucket, overlap).withColumn("similarity", similar(F.col("l_norm"), F.col("r_norm")))
    pairs = written(pairs.select(F.col("l_file_id").alias("file_id"), "l_ordinal", "l_index", "r_ordinal", "r_index", "similarity"), f"{path}/pairs")
    # One row for each left segment, with what overlaps it in order.
    hit = F.array_sort(F.collect_list(F.struct("r_ordinal", "r_index", "similarity")))
    own = a.join(pairs.groupBy("file_id", F.col("l_ordinal").alias("ordinal")).agg(hit.alias("hits")), ["file_id", "ordinal"], "left")
    moved = best_text_match(own.where("hits IS NULL").drop("hits"), b, text_threshold, similar)
    middle = lambda p: (F.col(f"{p}_start") + F.col(f"{p}_end")) / 2
    moved = written(moved.select(F.col("l_file_id").alias("file_id"), F.col("l_ordinal").alias("ordinal"), F.col("r_index").alias("moved_index"), F.col("similarity").alias("moved_similarity"), F.abs(middle("l") - middle("r")).alias("time_diff_s")), f"{path}/moved")
    n, first = F.size("hits"), F.get("hits", F.lit(0))
    exact = F.get(F.filter("hits", lambda h: h["similarity"] > ALMOST), F.lit(0))
    chosen = F.when(n == 1, first["r_index"]).otherwise(exact["r_index"])
    lefts = own.join(moved, ["file_id", "ordinal"], "left").select(
        "file_id",
        F.when(n == 1, F.when(first["similarity"] < ALMOST, "text_diff_only").otherwise("one_to_one")).when(n > 1, F.when(exact.isNotNull(), "one_to_one").otherwise("split"))
        .when(F.col("moved_index").isNotNull(), "timeline_mismatch").otherwise("missing").alias("pattern"),
        F.col("index").alias("left_index"), F.lit(None).cast("array<int>").alias("left_list"), F.coalesce(chosen, "moved_index").alias("right_index"),
        F.when((n > 1) & exact.isNull(), F.transform("hits", lambda h: h["r_index"])).alias("right_list"),
        F.when(n == 1, first["similarity"]).when((n > 1) & exact.isNotNull(), F.lit(1.0)).otherwise(F.col("moved_similarity")).alias("similarity"), "time_diff_s",
    )
    lefts = written(lefts, f"{path}/lefts")
    # Right segments that nothing matched, with what overlaps them.
    matched = lefts.select("file_id", F.explode(F.concat(F.array("right_index"), F.coalesce("right_list", F.array().cast("array<int>")))).alias("r_index")).where("r_index IS NOT NULL").distinct()
    by_right = pairs.groupBy("file_id", "r_ordinal", "r_index").agg(F.array_sort(F.collect_list(F.struct("l_ordinal", "l_index"))).alias("hits")).where("size(hits) > 1")
    merged = by_right.join(matched, ["file_id", "r_index"], "left_anti").select("file_id", F.lit("merged").alias("pattern"), F.transform("hits", lambda h: h["l_index"]).alias("left_list"), F.col("r_index").alias("right_index"))
    out = lefts.unionByName(merged, allowMissingColumns=True)
    return out.select("file_id", "pattern", "left_index", "left_list", "right_index", "right_list", "similarity", "time_diff_s", (F.col("time_diff_s") * 1000).alias("time_diff_ms"))


def pattern_counts(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("file_id", "pattern").agg(F.count("*").alias("n"))


def least_similar(patterns: DataFrame, pattern: str = "text_diff_only", n: int = 5) -> DataFrame:
    """The n least similar pairs of a pattern in each file."""
    w = Window.partitionBy("file_id").orderBy("similarity", "left_index")
    return patterns.where(F.col("pattern") == pattern).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def transcript_stats(segments: DataFrame) -> DataFrame:
    """Per file: segments, mean duration, words, mean words, first start and last segment's end, whole text."""
    words = word_count(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), " ")
    return segments.groupBy("file_id").agg(
        F.count("*").alias("n"), F.avg(F.col("end_time") - F.col("start_time")).alias("mean_s"), F.sum(words).alias("words"), F.avg(words).alias("mean_words"),
        F.min_by("start_time", "ordinal").alias("first_start"), F.max_by("end_time", "ordinal").alias("last_end"), text.alias("text"),
    )


def transcript_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of two transcript_stats by file; the loss in percent is null without words."""
    a, b = (df.select("file_id", *(F.col(c).alias(f"{p}_{c}") for c in ("n", "words", "first_start", "last_end"))) for df, p in ((left, "l"), (right, "r")))
    d = lambda c: F.col(f"r_{c}") - F.col(f"l_{c}")
    return a.join(b, "file_id").select("file_id", d("n").alias("segment_diff"), d("words").alias("word_diff"), (100 * (F.col("l_words") - F.col("r_words")) / F.when(F.col("l_words") != 0, F.col("l_words"))).alias("word_loss_pct"), d("first_start").alias("start_delta"), d("last_end").alias("end_delta"))


def report_json(summary: DataFrame, patterns: DataFrame) -> DataFrame:
    """file_id, report: summary, counts and details of each file as JSON. Timeline mismatches are part of it."""
    fields = [c for c in patterns.columns if c != "file_id"]
    details = patterns.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("details"))
    kinds = F.array_sort(F.array_distinct(F.transform("details", lambda x: x["pattern"])))
    counted = F.transform(kinds, lambda p: F.struct(p.alias("pattern"), F.size(F.filter("details", lambda x: x["pattern"] == p)).cast("long").alias("n")))
    body = F.struct(F.struct(*(c for c in summary.columns if c != "file_id")).alias("summary"), F.map_from_entries(counted).alias("counts"), "details")
    return summary.join(details, "file_id", "left").select("file_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def compare_metrics(left: DataFrame, right: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Named numbers that both sides have, and their difference."""
    return left.select(key, F.col(value).alias("left")).join(right.select(key, F.col(value).alias("right")), key).withColumn("diff", F.col("right") - F.col("left"))


def verdict(ours: Column, theirs: Column, factor: float = 3.0) -> Column:
    """Which side has over ``factor`` times the other's frames of its own."""
    return F.when(ours > factor * theirs, "left").when(theirs > factor * ours, "right").otherwise("balanced")
