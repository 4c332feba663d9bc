"""Sampled signals and voice masks.

Signals lie in arrays, one clip a row. What looks at frames works on the array in place; what needs a running sum or runs
goes to the long form (keys, i, x). Masks are best kept as runs [s, e).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge_gaps
from .names import private


def long_form(df: DataFrame, keys: Sequence[str], array: str, name: str = "x") -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias("i", name))


def to_mono(channels: Column) -> Column:
    """Mean of an array of channels, sample by sample."""
    total = F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))), F.transform(channels[0], lambda x: x.cast("double")), lambda a, b: F.zip_with(a, b, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(channels))


def scale_pcm(x: Column, bits: int = 16) -> Column:
    return F.transform(x, lambda v: v / float(1 << (bits - 1)))


def pcm16(x: Column) -> Column:
    """Samples in [-1, 1] as 16-bit numbers, clamped, then cut towards zero."""
    return F.transform(x, lambda v: F.greatest(F.least(v.cast("double") * 32767, F.lit(32767.0)), F.lit(-32768.0)).cast("short"))


def power(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def tumbling_rms(x: Column, frame: int) -> Column:
    """RMS of successive frames; the last is filled up with zeros."""
    n = F.ceil(F.size(x) / frame)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.sqrt(power(F.slice(x, k * frame + 1, F.lit(frame))) / frame))).otherwise(F.array().cast("array<double>"))


def hopping_rms(x: Column, frame: int, hop: int) -> Column:
    """RMS of frames that start each ``hop`` samples; a frame that ends with the signal is left out."""
    n = F.ceil((F.size(x) - frame) / hop)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.sqrt(power(F.slice(x, k * hop + 1, F.lit(frame))) / frame))).otherwise(F.array().cast("array<double>"))


def voice(rms: Column, threshold: float) -> Column:
    return F.transform(rms, lambda v: (v > threshold).cast("int"))


def moving_rms_mask(df: DataFrame, keys: Sequence[str], win: int, eps: float = 1e-4, x: str = "x") -> DataFrame:
    """Adds m to the long form: 1 where the RMS of the window around a sample reaches eps.

    The window of i is (i - win / 2, i + win - win / 2]; of an odd window the last sample's value is 0. Running sums are
    subtracted, so the cost doesn't depend on the window.
    """
    pad = win // 2
    w = Window.partitionBy(*keys).orderBy("i")
    upto = F.sum(F.col(x).cast("double") * F.col(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    so_far, last, every = (private(df, c) for c in ("_s", "_last", "_all"))
    out = df.withColumns({so_far: upto, last: F.max("i").over(Window.partitionBy(*keys)), every: F.sum(F.col(x).cast("double") * F.col(x)).over(Window.partitionBy(*keys))})
    ahead, behind = F.coalesce(F.lead(so_far, win - pad).over(w), F.col(every)), F.coalesce(F.lag(so_far, pad).over(w), F.lit(0.0))
    m = (F.sqrt(F.greatest(ahead - behind, F.lit(0.0)) / win + 1e-12) >= eps).cast("int")
    if win % 2:
        m = F.when(F.col("i") == F.col(last), 0).otherwise(m)
    return out.withColumn("m", m).drop(so_far, last, every)


def mask_runs(df: DataFrame, keys: Sequence[str], m: str = "m") -> DataFrame:
    """keys, s, len of the stretches of ones in the long form."""
    w = Window.partitionBy(*keys).orderBy("i")
    run = private(df, "_run")
    return df.where(F.col(m) == 1).withColumn(run, F.col("i") - F.row_number().over(w)).groupBy(*keys, run).agg(F.min("i").alias("s"), F.count("*").alias("len")).drop(run)


def top_runs(runs: DataFrame, keys: Sequence[str], n: int = 15) -> DataFrame:
    """The n longest runs of each key, the earliest of ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("len"), "s")
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pair_signals(left: DataFrame, right: DataFrame, keys: Sequence[str], pad: bool = False) -> DataFrame:
    """Two long forms sample by sample as a, b: cut to the shorter one, or filled up with zeros."""
    a, b = left.withColumnRenamed("x", "a"), right.withColumnRenamed("x", "b")
    out = a.join(b, [*keys, "i"], "full_outer" if pad else "inner")
    return out.na.fill(0, ["a", "b"]) if pad else out


def shift_mask(df: DataFrame, keys: Sequence[str], shift: Column, n: Column) -> DataFrame:
    """A long form's ones moved to i - shift; what leaves [0, n) is lost, what is free is 0 and left out."""
    moved = F.col("i") - shift
    return df.where("m = 1").withColumn("i", moved).where((F.col("i") >= 0) & (F.col("i") < n))


def mask_confusion(pairs: DataFrame, keys: Sequence[str], rate: float = 1000.0) -> DataFrame:
    """Agreement of masks a and b (0 or 1, null as 0): counts, IoU, precision, recall and milliseconds; over nothing 1."""
    a, b = F.coalesce(F.col("a"), F.lit(0)), F.coalesce(F.col("b"), F.lit(0))
    sums = pairs.groupBy(*keys).agg(F.sum(a * b).alias("inter"), F.sum(F.greatest(a, b)).alias("union_"), F.sum(a).alias("left_n"), F.sum(b).alias("right_n"))
    ratio = lambda over: F.when(F.col(over) == 0, F.lit(1.0)).otherwise(F.col("inter") / F.col(over))
    ms = lambda c: F.round(c * 1000.0 / rate, 1)
    return sums.withColumns(
        {
            "iou": F.round(ratio("union_"), 4), "precision": F.round(ratio("left_n"), 4), "recall": F.round(ratio("right_n"), 4),
            "left_ms": ms(F.col("left_n")), "right_ms": ms(F.col("right_n")), "symdiff_ms": ms(F.col("union_") - F.col("inter")),
        }
    )


def frame_confusion(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with voice on each side, on one only, and on either only."""
    a, b = F.col("a"), F.col("b")
    n = lambda c: F.sum(c.cast("long"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("frames"), n(a).alias("left_voice"), n(b).alias("right_voice"), n(F.when(a != b, 1).otherwise(0)).alias("xor_frames"), n(F.when((a == 1) & (b == 0), 1).otherwise(0)).alias("left_only"), n(F.when((a == 0) & (b == 1), 1).otherwise(0)).alias("right_only"))


def best_offset(a_runs: DataFrame, b_runs: DataFrame, keys: Sequence[str], max_shift: int) -> DataFrame:
    """keys, shift, score: the shift that makes most ones meet, a[i] with b[i + shift]; the smallest of ties.

    Clips are cut in blocks of time. A block's ones of a, and of b as far as a shift can bring them there, are correlated by
    a Fourier transform, so the cost is samples times the logarithm of a block, however many runs there are; a clip's blocks
    are tasks of their own, and their scores are added up by shift.
    """
    width = max(4 * max_shift, 4096)
    own = [f"_key{i}" for i in range(len(keys))]

    def spread(runs: DataFrame, side: str, reach: int) -> DataFrame:
        """A row for each block that a run, or what it may be moved to, lies in; places count from the block's reach on."""
        s, e = F.col("s").cast("long"), (F.col("s") + F.col("len")).cast("long")
        rows = runs.where("len > 0").select(*(F.col(k).alias(o) for k, o in zip(keys, own)), s.alias("s"), e.alias("e"), F.explode(F.sequence(F.floor((s - reach) / width), F.floor((e - 1 + reach) / width))).alias("block"))
        first, last = F.col("block") * width - reach, (F.col("block") + 1) * width + reach
        return rows.select(*own, "block", F.lit(side).alias("side"), (F.greatest("s", first) - first).alias("s"), (F.least("e", last) - first).alias("e"))

    both = spread(a_runs, "a", 0).unionByName(spread(b_runs, "b", max_shift))
    held = lambda side, c: F.collect_list(F.when(F.col("side") == side, F.col(c)))  # noqa: E731  a block holds half as many runs as samples at most
    blocks = both.groupBy(*own, "block").agg(*(held(x, c).alias(f"{x}_{c}") for x in "ab" for c in "se")).where("size(a_s) > 0")

    @F.pandas_udf("array<long>")
    def scores(a_s: pd.Series, a_e: pd.Series, b_s: pd.Series, b_e: pd.Series) -> pd.Series:
        size = width + 2 * max_shift

        def ones(starts, ends) -> np.ndarray:
            steps = np.zeros(size + 1)
            np.add.at(steps, starts.astype(int), 1)
            np.add.at(steps, ends.astype(int), -1)
            return np.minimum(np.cumsum(steps[:-1]), 1)

        def one(row) -> np.ndarray:
            if not len(row[2]):
                return np.zeros(2 * max_shift + 1, np.int64)
            # b starts max_shift before a does, so a shift of -max_shift meets at lag 0; lags wrap beyond those asked for.
            met = np.fft.irfft(np.conj(np.fft.rfft(ones(row[0], row[1]))) * np.fft.rfft(ones(row[2], row[3])), size)
            return np.rint(met[: 2 * max_shift + 1]).astype(np.int64)

        return pd.Series([one(r) for r in zip(a_s, a_e, b_s, b_e)])

    each = blocks.select(*own, F.posexplode(scores("a_s", "a_e", "b_s", "b_e")).alias("k", "n"))
    score = each.groupBy(*own, "k").agg(F.sum("n").alias("score"))
    best = score.groupBy(*own).agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("best"))
    return best.select(*(F.col(o).alias(k) for k, o in zip(keys, own)), (-F.col("best.k") - max_shift).cast("long").alias("shift"), "best.score")


def difference(a: Column, b: Column) -> Column:
    """b - a, cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: y.cast("double") - x.cast("double"))


def level_db(x: Column) -> Column:
    """RMS level of a whole signal in dBFS."""
    return 20 * F.log10(F.greatest(F.sqrt(power(x) / F.size(x)), F.lit(1e-12)))


def resample_linear(x: Column, rate_from: int, rate_to: int) -> Column:
    """Linear interpolation to another rate; past the end the last sample holds."""
    n = F.floor(F.size(x) * F.lit(rate_to) / F.lit(rate_from)).cast("int")
    at = lambda k: k.cast("double") * rate_from / rate_to
    last = F.size(x) - 1

    def value(k: Column) -> Column:
        lo = F.least(F.floor(at(k)).cast("int"), last)
        a, b = F.get(x, lo).cast("double"), F.get(x, F.least(lo + 1, last)).cast("double")
        return a + (b - a) * F.least(at(k) - lo, F.lit(1.0))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<double>"))


def filter_taps(up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """A windowed sine cardinal that keeps what both rates can hold, ten zero crossings to each side, for gain ``up``."""
    widest = max(up, down)
    half = 10 * widest
    t = np.arange(-half, half + 1) / widest
    h = np.sinc(t) * np.kaiser(2 * half + 1, beta)
    return up * h / h.sum()


def resample(x: Column, rate_from: int, rate_to: int) -> Column:
    """Another rate by a polyphase filter bank: both rates over their greatest common divisor, zeros beyond the ends.

    Sample m of the result is the sum of x[k] taps[half + m down - k up]; only these sums are worked out, each over the
    taps of its phase. The result has ceil(n up / down) samples.
    """
    common = math.gcd(rate_from, rate_to)
    up, down = rate_to // common, rate_from // common
    taps = filter_taps(up, down)
    half = len(taps) // 2
    each = -(-len(taps) // up)  # taps of a phase
    bank = np.zeros(each * up)
    bank[: len(taps)] = taps
    bank = bank.reshape(each, up).T

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            wide = np.pad(np.asarray(v, np.float64), each)
            n = -(-len(v) * up // down)
            out = np.empty(n)
            for at in range(0, n, 1 << 14):
                place = np.arange(at, min(n, at + (1 << 14))) * down + half
                rows = (place // up)[:, None] - np.arange(each) + each
                held = (rows >= 0) & (rows < len(wide))
                out[at : at + len(place)] = np.einsum("ij,ij->i", np.where(held, wide[np.clip(rows, 0, len(wide) - 1)], 0.0), bank[place % up])
            return out

        return values.map(one)

    return run(x)


def window_of(x: Column, rate: int, t0: float, t1: float) -> Column:
    """Samples from t0 to t1; under two of them the first two seconds instead."""
    a, b = int(t0 * rate), int(t1 * rate)
    cut = F.slice(x, a + 1, max(0, b - a))
    return F.when(F.size(cut) < 2, F.slice(x, 1, 2 * rate)).otherwise(cut)


def suppress(df: DataFrame, quiet: DataFrame, keys: Sequence[str], array: str = "x") -> DataFrame:
    """Zero the samples inside the quiet stretches (keys, start, end) of each clip; lengths stay.

    Stretches that overlap or touch are joined first; then the clip is put together from what lies between them and zeros,
    so the cost is samples and stretches.
    """
    whole = quiet.where("end > start").select(*keys, F.greatest(F.col("start"), F.lit(0)).cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    name = private(df, "_quiet")
    held = merge_gaps(whole, keys, 0.0).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))
    out = df.join(held, list(keys), "left")
    n, x = F.size(array), F.transform(array, lambda v: v.cast("double"))
    start = lambda q: F.least(q["start"], n)
    end = lambda q: F.least(q["end"], n)
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(end(F.get(name, k - 1)))
    parts = F.transform(name, lambda q, k: F.concat(F.slice(array, before(k) + 1, F.greatest(start(q) - before(k), F.lit(0))), F.array_repeat(F.lit(0.0).cast(df.schema[array].dataType.elementType), F.greatest(end(q) - start(q), F.lit(0)))))
    rest = F.slice(array, end(F.get(name, F.size(name) - 1)) + 1, F.greatest(n, F.lit(1)))
    joined = F.transform(F.concat(F.flatten(parts), rest), lambda v: v.cast("double"))
    return out.withColumn(array, F.when(F.col(name).isNull(), x).otherwise(joined)).drop(name)


def signal_stats(x: Column) -> Column:
    """struct<lowest, highest, mean_abs>."""
    return F.struct(F.array_min(x).alias("lowest"), F.array_max(x).alias("highest"), (F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))) / F.size(x)).alias("mean_abs"))


def spectrum_db(x: Column, frame: int = 2048, hop: int = 512) -> Column:
    """Short-time spectrum in dB below its largest value, frames centred and padded with zeros: array<array<double>>."""

    @F.pandas_udf("array<array<double>>")
    def run(values: pd.Series) -> pd.Series:
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)

        def one(v):
            if v is None or not len(v):
                return []
            wide = np.pad(np.asarray(v, np.float64), frame // 2)
            frames = np.lib.stride_tricks.sliding_window_view(wide, frame)[::hop]
            size = np.abs(np.fft.rfft(frames * taper, axis=1))
            top = max(size.max(), 1e-10)
            return np.maximum(20 * np.log10(np.maximum(size, 1e-10) / top), -80.0).tolist()

        return values.map(one)

    return run(x)


def centred_rms(x: Column, frame: int = 2048, hop: int = 512) -> Column:
    """RMS of frames centred at each hop, padded with zeros."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None or not len(v):
                return []
            upto = np.r_[0.0, np.cumsum(np.pad(np.asarray(v, np.float64), frame // 2) ** 2)]
            return np.sqrt(np.maximum(upto[frame:] - upto[:-frame], 0)[::hop] / frame).tolist()

        return values.map(one)

    return run(x)


def time_axis(x: Column, rate: Column | int, duration: Column | None = None) -> Column:
    """Seconds of each sample: i / rate, or, with a duration, evenly from 0 to it, both included."""
    n = F.size(x)
    at = (lambda i: i / rate) if duration is None else (lambda i: i * duration / F.greatest(n - 1, F.lit(1)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def paint_mask(intervals: DataFrame, clips: DataFrame, keys: Sequence[str], rate: int) -> DataFrame:
    """keys, i of every sample inside an interval of seconds [start, end), once; for what needs single samples.

    Where runs will do, keep intervals: merge_gaps and silences work on those without a row for each sample.
    """
    cut = intervals.join(clips, list(keys)).select(*keys, F.greatest((F.col("start") * rate).cast("long"), F.lit(0)).alias("s"), F.least((F.col("end") * rate).cast("long"), F.col("n")).alias("e")).where("e > s")
    return cut.select(*keys, F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("i")).distinct()
