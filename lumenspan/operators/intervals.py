"""Interval algebra over rows with a start and an end. Every window is partitioned by a key, in large tables by a slice of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import private
from .scan import Slices, slice_count

#: The most buckets for which an interval is repeated, and levels of ever wider buckets.
BUCKETS, LEVELS = 1024, 5


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float, on: Callable[[DataFrame], Column] | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of overlapping intervals with equal keys, as an equi-join on time buckets.

    Each side is repeated for the buckets that it touches, and a pair is kept only in the bucket where the later of the
    two starts lies, so it appears once. Columns get the prefixes ``l_`` and ``r_``. Intervals that only touch pair up too;
    ``on`` can ask for more. Choose a width near the usual duration: an interval of more than BUCKETS buckets takes part with
    buckets BUCKETS times as wide, and so on, so no interval is repeated more often; a pair meets on its longer one's level.
    """

    def levelled(df: DataFrame) -> DataFrame:
        """Adds _own: the first level on which an interval has at most BUCKETS buckets."""
        over = F.floor(F.col(end) / bucket) - F.floor(F.col(start) / bucket)
        own = F.lit(LEVELS - 1)
        for k in reversed(range(LEVELS - 1)):
            own = F.when(over <= BUCKETS ** (k + 1), k).otherwise(own)
        return df.where(F.col(end) >= F.col(start)).withColumn(held, own)

    def width(level: Column) -> Column:
        return F.lit(float(bucket)) * F.pow(F.lit(float(BUCKETS)), level)

    def spread(df: DataFrame, other: DataFrame, p: str, q: str) -> DataFrame:
        # On its own level an interval meets those of the same level, and shorter ones if it is longer than usual; on the
        # levels above only longer ones, as far as the other side has any.
        top = private(df, "_top")
        df = df.withColumn(top, F.coalesce(other.agg(F.max(held)).scalar(), F.lit(0)))
        levels = F.sequence(F.col(held), F.greatest(held, top))
        entry = lambda k, kind: F.struct(k.alias("_level"), F.lit(kind).alias("_kind"))
        places = F.flatten(F.transform(levels, lambda k: F.when(k > F.col(held), F.array(entry(k, q))).when(k == 0, F.array(entry(k, "="))).otherwise(F.array(entry(k, "="), entry(k, p)))))
        rows = df.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.inline(places), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in (held, top)))
        at = lambda c: F.floor(F.col(f"{p}_{c}") / width(F.col("_level")))
        return rows.withColumn("_bucket", F.explode(F.sequence(at(start), at(end))))

    held = private(left, private(right, "_own"))
    a, b = levelled(left), levelled(right)
    pairs = spread(a, b, "l", "r").join(spread(b, a, "r", "l"), ["_bucket", "_level", "_kind", *(f"_key{i}" for i in range(len(keys)))])
    later = F.greatest(f"l_{start}", f"r_{start}")
    pairs = pairs.where((F.col("_bucket") == F.floor(later / width(F.col("_level")))) & (later <= F.least(f"l_{end}", f"r_{end}")))
    pairs = pairs.drop("_bucket", "_level", "_kind", *(f"_key{i}" for i in range(len(keys))))
    return pairs.where(on(pairs)) if on is not None else pairs


def overlap_ratio_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float, threshold: float = 0.2, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs whose overlap covers ``threshold`` of the shorter one; intervals without duration never pair. Adds ratio."""
    shorter = F.least(F.col(f"l_{end}") - F.col(f"l_{start}"), F.col(f"r_{end}") - F.col(f"r_{start}"))
    both = F.least(f"l_{end}", f"r_{end}") - F.greatest(f"l_{start}", f"r_{start}")
    pairs = interval_join(left.where(F.col(end) > F.col(start)), right.where(F.col(end) > F.col(start)), keys, bucket, None, start, end)
    return pairs.withColumn("ratio", F.greatest(F.lit(0.0), both) / shorter).where(F.col("ratio") >= threshold)


def positional_compare(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], tolerance_ms: float = 50.0) -> DataFrame:
    """The k-th interval of one side against the k-th of the other: match, differs, only_left or only_right."""
    w = Window.partitionBy(*keys).orderBy(*order)

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, (F.row_number().over(w) - 1).alias("ord"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))

    ms = lambda c: F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) * 1000
    out = side(left, "left").join(side(right, "right"), [*keys, "ord"], "full_outer").withColumns({"start_diff_ms": ms("start"), "end_diff_ms": ms("end")})
    near = (F.col("start_diff_ms") <= tolerance_ms) & (F.col("end_diff_ms") <= tolerance_ms)
    return out.withColumn("status", F.when(F.col("right_start").isNull(), "only_left").when(F.col("left_start").isNull(), "only_right").when(near, "match").otherwise("differs"))


def positional_stats(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Matched and common rows, rate in percent, mean differences of the common ones in milliseconds."""
    both = F.col("status").isin("match", "differs")
    n = F.sum(both.cast("long"))
    matched = F.sum((F.col("status") == "match").cast("long"))
    return compared.groupBy(*keys).agg(
        matched.alias("matched"), n.alias("common"), (100 * matched / F.when(n > 0, n)).alias("rate_pct"),
        F.avg(F.when(both, F.col("start_diff_ms"))).alias("mean_start_diff_ms"), F.avg(F.when(both, F.col("end_diff_ms"))).alias("mean_end_diff_ms"),
    )


def adjacent(df: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each row with the named columns of the next one as ``next_*``; the last row of a key is left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    more = private(df, "_more")
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in names} | {more: F.lead(F.lit(1)).over(w)}).where(F.col(more) == 1).drop(more)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """An array column followed by the next row's; the last row of a key keeps its own."""
    after = F.lead(name).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.concat(F.col(name), F.coalesce(after, F.slice(F.col(name), 1, 0))))


def gaps(df: DataFrame, keys: Sequence[str], tie: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """Adds gap: the time since the end of the interval before, 0 at least; null for the first.

    Large tables are cut in ``slices`` of the order (key, start, end, tie), so that no task holds a whole key; the end of the
    last interval of the slices before is carried into the next.
    """
    rows, at, cut, w = _sliced(df, keys, ["start", "end", *tie], slices)
    before = F.lag(F.struct("end")).over(w)
    if cut is not None:
        held = private(rows, "_before")
        rows = cut.carried(rows, at, {held: F.max_by(F.struct("end"), F.struct("start", "end", *tie))}, {held: _last})
        before = F.coalesce(before, held)
    upto = before["end"]
    return rows.withColumn("gap", F.when(upto.isNotNull(), F.greatest(F.lit(0.0), F.col("start") - upto))).select(*df.columns, "gap")


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None):
    """The rows with their slice, its column, the slices, and a window over a key's rows in a slice; one slice is none."""
    n = slices or slice_count(df)
    if n == 1:
        return df, None, None, Window.partitionBy(*keys).orderBy(*order)
    at, cut = private(df, "_slice"), Slices(df, keys, order, n)
    return df.withColumn(at, cut.number), at, cut, Window.partitionBy(at, *keys).orderBy(*order)


def _last(c: Column) -> Column:
    return F.last(c, True)


def merge_gaps(df: DataFrame, keys: Sequence[str], merge_window: float = 1.5, tie: Sequence[str] = (), text: str | None = None, slices: int | None = None) -> DataFrame:
    """Join intervals that start within ``merge_window`` of the end so far: start, end, n and, if named, the joined text.

    Rows without times are no part of this; pass them by yourself. In large tables the largest end so far and the number of
    blocks so far are carried from slice to slice, so a key's rows lie in as many tasks as there are slices.
    """
    rows, at, cut, w = _sliced(df.where(F.col("start").isNotNull()), keys, ["start", "end", *tie], slices)
    held, new, first = private(rows, "_upto"), private(rows, "_new"), private(rows, "_first")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    if cut is not None:
        rows = cut.carried(rows, at, {held: F.max("end")}, {held: F.max})
        upto = F.greatest(upto, held)
    rows = rows.withColumn(new, F.when(F.col("start") - upto <= merge_window, 0).otherwise(1))
    block = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if cut is not None:
        rows = cut.carried(rows, at, {first: F.sum(new)}, {first: F.sum})
        block = block + F.coalesce(first, F.lit(0))
    blocks = rows.withColumn("block", block)
    cols = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")]
    if text:
        joined = F.array_sort(F.collect_list(F.struct("start", "end", *tie, F.col(text).alias("_text"))))
        cols.append(F.array_join(F.transform(joined, lambda s: s["_text"]), " ").alias(text))
    return blocks.groupBy(*keys, "block").agg(*cols)


def silences(speech: DataFrame, clips: DataFrame, keys: Sequence[str], slices: int | None = None) -> DataFrame:
    """Stretches without speech, head and tail included, of clips [0, n); speech is clipped to them and may overlap.

    speech: keys, start, end. clips: keys, n. A clip without speech is one silence. In large tables the end so far is
    carried forward and the next start backward between slices.
    """
    cut = speech.join(clips, list(keys)).select(*keys, "n", F.greatest(F.col("start"), F.lit(0)).alias("start"), F.least("end", "n").alias("end")).where("end > start").select(*keys, "start", "end")
    bounds = cut.unionByName(clips.select(*keys, F.lit(0).cast(speech.schema["start"].dataType).alias("start"), F.lit(0).cast(speech.schema["end"].dataType).alias("end")))
    rows, at, parts, w = _sliced(bounds, keys, ["start", "end"], slices)
    upto, after = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lead("start").over(w)
    if parts is not None:
        rows = parts.carried(rows, at, {"_held": F.max("end")}, {"_held": F.max})
        rows = parts.carried(rows, at, {"_next": F.min("start")}, {"_next": F.min}, after=True)
        upto, after = F.greatest(upto, "_held"), F.coalesce(after, "_next")
    out = rows.withColumns({"_from": upto, "_to": after}).join(clips, list(keys))
    return out.select(*keys, F.col("_from").alias("start"), F.coalesce("_to", "n").alias("end")).where("end > start")


def silence_accounts(speech: DataFrame, clips: DataFrame, keys: Sequence[str], rate: float = 1.0, threshold_s: float = 1.0) -> DataFrame:
    """Speech, long and short silence of each clip in seconds; together they are the clip."""
    quiet = silences(speech, clips, keys).withColumn("s", (F.col("end") - F.col("start")) / rate)
    long = F.col("s") >= threshold_s
    sums = quiet.groupBy(*keys).agg(F.sum(F.when(long, F.col("s")).otherwise(0.0)).alias("long_s"), F.sum(F.when(~long, F.col("s")).otherwise(0.0)).alias("short_s"))
    out = clips.join(sums, list(keys), "left").na.fill(0.0, ["long_s", "short_s"])
    return out.withColumn("speech_s", F.col("n") / rate - F.col("long_s") - F.col("short_s"))


def overlaps_window(start: Column, end: Column, a, b, inclusive: bool = False) -> Column:
    """Whether an interval overlaps [a, b]; touching counts only if ``inclusive``."""
    return ((end >= a) & (start <= b)) if inclusive else ((start < b) & (end > a))


def clip_to_window(df: DataFrame, a, b) -> DataFrame:
    """Intervals that overlap or touch [a, b], cut to it."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return df.where(overlaps_window(F.col("start"), F.col("end"), a, b, True)).withColumns({"start": F.greatest(F.col("start"), a), "end": F.least(F.col("end"), b)})


def boundary_windows(df: DataFrame, at: str, duration: Column, context: float = 5.0) -> DataFrame:
    """Adds window_start and window_end around ``at``, within the recording."""
    return df.withColumns({"window_start": F.greatest(F.lit(0.0), F.col(at) - context), "window_end": F.least(duration, F.col(at) + context)})


def edge_windows(df: DataFrame, start: str, end: str, duration: Column, context: float = 3.0) -> DataFrame:
    """Views of a chunk's two edges: half a context outside, one and a half inside."""
    return df.withColumns(
        {
            "head_start": F.greatest(F.lit(0.0), F.col(start) - 0.5 * context), "head_end": F.least(duration, F.col(start) + 1.5 * context),
            "tail_start": F.greatest(F.lit(0.0), F.col(end) - 1.5 * context), "tail_end": F.least(duration, F.col(end) + 0.5 * context),
        }
    )


def keep_first_rounded(df: DataFrame, keys: Sequence[str], order: str, places: int = 3) -> DataFrame:
    """The first row of each pair of start and end, rounded."""
    w = Window.partitionBy(*keys, F.round("start", places), F.round("end", places)).orderBy(order)
    rank = private(df, "_k")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def speech_totals(df: DataFrame, keys: Sequence[str], clip_seconds: Column) -> DataFrame:
    """Seconds of speech and their share of the clip; overlaps count twice."""
    return df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("speech_s"), F.max(clip_seconds).alias("clip_s")).withColumn("speech_pct", 100 * F.col("speech_s") / F.when(F.col("clip_s") > 0, F.col("clip_s")))
