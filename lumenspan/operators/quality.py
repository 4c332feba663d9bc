"""Quantiles and summaries of segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import gaps
from .scan import slice_count
from .selection import at_ranks


def exclusive_quantile(values: Column, i: int, n: int = 10) -> Column:
    """The i-th of n-quantiles of a list by the exclusive method, which can lie beyond the smallest and largest value.

    An empty list gives null, a single value itself.
    """
    d = F.array_sort(values)
    size = F.size(values)
    m = size + 1
    j = F.greatest(F.lit(1), F.least(F.floor(i * m / n), size - 1)).cast("int")
    rest = i * m - j * n
    return F.when(size == 1, F.get(d, F.lit(0))).when(size > 1, (F.get(d, j - 1) * (n - rest) + F.get(d, j) * rest) / n)


def segment_summary(df: DataFrame, keys: Sequence[str], words: Column | None = None, short: float = 0.5, tiny: float = 0.2, long: float = 1.0, slices: int | None = None) -> DataFrame:
    """Counts, durations, gaps and coverage of each key's segments, ordered by start and end.

    Durations and gaps are 0 at least. ``words`` counts a segment's words; segments without any don't enter the mean.
    Quantiles pick values by their rank, so no key's values are held in one row. In large tables a key's rows are cut in
    ``slices``: gaps are carried between them, and ranks are found by selection, so no task sorts a whole key. A key with one
    segment has no gaps, and null for all that is told of them; an empty table gives no rows.
    """
    n_slices = slices or slice_count(df)
    seconds = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    words = words if words is not None else F.lit(0)
    names = [f"key{i}" for i in range(len(keys))]
    own = gaps(df, keys, slices=n_slices).select(*(F.col(k).alias(c) for k, c in zip(keys, names)), "start", "end", "gap", seconds.alias("d"), words.alias("w"))
    ratio = lambda c, over: F.sum(c.cast("long")) / F.when(over > 0, over)
    n, n_gaps = F.count("*"), F.count("gap")
    told = {
        "n": n, "mean_s": F.avg("d"), "short_ratio": ratio(F.col("d") < short, n), "tiny_gap_ratio": ratio(F.col("gap") < tiny, n_gaps),
        "long_gaps": F.sum((F.coalesce(F.col("gap"), F.lit(0.0)) >= long).cast("long")), "mean_words": F.avg(F.when(F.col("w") > 0, F.col("w"))),
        "coverage_s": F.sum("d"), "span_s": F.max_by("end", F.struct("start", "end")) - F.min("start"),
    }
    ranked = {"median_s": _median("d"), "gap_median_s": _median("gap")} | {f"{p}p{10 * i}_s": _exclusive(c, i) for p, c in (("", "d"), ("gap_", "gap")) for i in (1, 9)}
    order = [*keys, "n", "mean_s", "median_s", "short_ratio", "gap_median_s", "tiny_gap_ratio", "long_gaps", "mean_words", "coverage_s", "span_s", "p10_s", "p90_s", "gap_p10_s", "gap_p90_s"]
    keyed = lambda of: [F.col(c).alias(k) for c, k in zip(of, keys)]
    if n_slices == 1:
        whole = Window.partitionBy(*names)
        ranks = (x for c in ("d", "gap") for x in (F.row_number().over(whole.orderBy(F.asc_nulls_last(c))).alias(f"rank_{c}"), F.count(c).over(whole).alias(f"size_{c}")))
        return own.select("*", *ranks).groupBy(*keyed(names)).agg(*(x.alias(c) for c, x in (told | ranked).items())).select(*order)
    sums = own.groupBy(*names).agg(*(x.alias(c) for c, x in told.items()), F.count("d").alias("size_d"), n_gaps.alias("size_gap"))
    wanted = sums.select(*names, F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), r.cast("long").alias("rank")) for c in ("d", "gap") for r in _ranks(F.col(f"size_{c}"))))).alias("x"))
    tall = own.select(*names, F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in ("d", "gap")))).alias("x")).select(*names, "x.stat", "x.value")
    found = at_ranks(tall, [*names, "stat"], "value", wanted.select(*names, "x.stat", "x.rank"), n_slices)
    held = [f"of{i}" for i in range(len(keys))]
    found = found.select(*(F.col(c).alias(h) for c, h in zip(names, held)), *(F.when(F.col("stat") == c, F.col(x)).alias(y) for c in ("d", "gap") for x, y in (("rank", f"rank_{c}"), ("value", c))))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(d)) for c, d in zip(a, b)), F.lit(True))
    picked = found.join(sums.select(*names, "size_d", "size_gap"), same(held, names)).groupBy(*held).agg(*(x.alias(c) for c, x in ranked.items()))
    return sums.drop("size_d", "size_gap").join(picked, same(names, held), "left").select(*keyed(names), *order[len(keys) :])


def _ranks(size: Column) -> list[Column]:
    """The ranks that the median and the outer deciles need."""
    first = [F.greatest(F.lit(1), F.least(F.floor(i * (size + 1) / 10), size - 1)) for i in (1, 9)]
    return [F.floor((size + 1) / 2), F.ceil((size + 1) / 2), *first, *(r + 1 for r in first)]


def _at(c: str, rank: Column) -> Column:
    """The value of that rank, as an aggregate over rows with rank_c and size_c."""
    return F.max(F.when(F.col(f"rank_{c}") == rank, F.col(c)))


def _median(c: str) -> Column:
    size = F.col(f"size_{c}")
    return (_at(c, F.floor((size + 1) / 2)) + _at(c, F.ceil((size + 1) / 2))) / 2


def _exclusive(c: str, i: int, n: int = 10) -> Column:
    """exclusive_quantile() by ranks."""
    size = F.col(f"size_{c}")
    j = F.greatest(F.lit(1), F.least(F.floor(i * (size + 1) / n), size - 1))
    rest = F.max(i * (size + 1) - j * n)
    return F.when(F.max(size) == 1, _at(c, F.lit(1))).when(F.max(size) > 1, (_at(c, j) * (n - rest) + _at(c, j + 1) * rest) / n)
