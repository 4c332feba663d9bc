"""Queries on signals: an embedding stands for a clip of 64 samples, nominally 64 a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, match, signal
from .etl_queries import table


def clips(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding")


def loud(spark, d):
    """Long form with a mask: samples above 0."""
    return signal.long_form(clips(spark, d), ["vec_id"], "embedding").withColumn("m", (F.col("x") > 0).cast("int"))


def mask_pairs(spark, d):
    """Each clip's mask against the next clip's."""
    m = loud(spark, d)
    a = m.select(F.col("vec_id").alias("pair"), "i", F.col("m").alias("a"))
    b = m.select((F.col("vec_id") - 1).alias("pair"), "i", F.col("m").alias("b"))
    return a.join(b, ["pair", "i"])


def frame_rms_tumbling(spark, d):
    return clips(spark, d).select("vec_id", F.posexplode(signal.tumbling_rms(F.col("embedding"), 10)).alias("k", "rms")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("rms", 6).alias("rms"))


def frame_rms_hopping(spark, d):
    return clips(spark, d).select("vec_id", F.posexplode(signal.hopping_rms(F.col("embedding"), 16, 8)).alias("k", "rms")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("rms", 6).alias("rms"))


def rms_summary(spark, d):
    r = clips(spark, d).select("vec_id", F.explode(signal.tumbling_rms(F.col("embedding"), 8)).alias("rms"))
    return r.groupBy("vec_id").agg(*(F.round(x, 6).alias(n) for n, x in (("lowest", F.min("rms")), ("median", F.percentile("rms", F.lit(0.5))), ("highest", F.max("rms")))))


def moving_rms_mask(spark, d):
    out = signal.moving_rms_mask(signal.long_form(clips(spark, d), ["vec_id"], "embedding"), ["vec_id"], 5, 0.121)
    return out.select("vec_id", F.col("i").cast("long").alias("i"), "m")


def mask_runs(spark, d):
    return signal.mask_runs(loud(spark, d), ["vec_id"]).select("vec_id", F.col("s").cast("long").alias("s"), "len")


def topn_runs(spark, d):
    return signal.top_runs(signal.mask_runs(loud(spark, d), ["vec_id"]), ["vec_id"], 3).select("vec_id", F.col("s").cast("long").alias("s"), "len", F.col("rank").cast("long").alias("rank"))


def mask_confusion(spark, d):
    return signal.mask_confusion(mask_pairs(spark, d), ["pair"], 64.0).withColumnRenamed("union_", "n_union")


def frame_confusion(spark, d):
    return signal.frame_confusion(mask_pairs(spark, d), ["pair"])


def best_offset(spark, d):
    runs = signal.mask_runs(loud(spark, d), ["vec_id"])
    a, b = runs.withColumnRenamed("vec_id", "pair"), runs.select((F.col("vec_id") - 1).alias("pair"), "s", "len")
    there = clips(spark, d).select((F.col("vec_id") - 1).alias("pair"))  # the last clip has no next one
    return signal.best_offset(a.join(there, "pair", "left_semi"), b, ["pair"], 8).select("pair", "shift", "score")


def shift_mask(spark, d):
    out = signal.shift_mask(loud(spark, d), ["vec_id"], F.col("vec_id") % 7 - 3, F.lit(64))
    return out.select("vec_id", F.col("i").cast("long").alias("i"))


def rms_dbfs(spark, d):
    return clips(spark, d).select("vec_id", F.round(signal.level_db(F.col("embedding")), 4).alias("dbfs"), signal.signal_stats(F.col("embedding")).alias("s")).select("vec_id", "dbfs", *(F.round(F.col(f"s.{c}").cast("double"), 6).alias(c) for c in ("lowest", "highest", "mean_abs")))


def diff_signal(spark, d):
    c = clips(spark, d)
    other = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return c.join(other, "vec_id").select("vec_id", F.posexplode(signal.difference(F.col("embedding"), F.col("next"))).alias("i", "d")).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("d") * F.col("d")), 5).alias("energy"))


def linear_resample(spark, d):
    return clips(spark, d).select("vec_id", F.posexplode(signal.resample_linear(F.col("embedding"), 64, 48)).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def polyphase_resample(spark, d):
    return clips(spark, d).select("vec_id", F.posexplode(signal.resample(F.col("embedding"), 64, 48)).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def time_slice(spark, d):
    """A quarter second of each clip; of a slice that holds under two samples, the first two seconds."""
    x = F.col("embedding")
    each = clips(spark, d).select("vec_id", F.inline(F.array(*(F.struct(F.lit(k).alias("part"), signal.window_of(x, 64, a, b).alias("x")) for k, (a, b) in enumerate(((0.25, 0.5), (0.5, 0.51), (0.9, 2.0)))))))
    return each.select("vec_id", "part", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double")), 5).alias("total"))


def centred_rms(spark, d):
    """Frames of 32 around each 16th sample."""
    return clips(spark, d).select("vec_id", F.posexplode(signal.centred_rms(F.col("embedding"), 32, 16)).alias("k", "rms")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("rms", 6).alias("rms"))


def filter_verdict(spark, d):
    """Which of two neighbouring clips' masks keeps far more frames of its own."""
    c = signal.frame_confusion(mask_pairs(spark, d), ["pair"])
    return c.select("pair", "left_only", "right_only", match.verdict(F.col("left_only"), F.col("right_only"), 1.2).alias("verdict"))


def pcm16_quantise(spark, d):
    return clips(spark, d).select("vec_id", F.posexplode(signal.pcm16(F.col("embedding"))).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


def silence_suppressed(spark, d):
    c = clips(spark, d)
    runs = signal.mask_runs(loud(spark, d).where("x > 0.05"), ["vec_id"])
    speech = runs.select("vec_id", F.col("s").cast("long").alias("start"), (F.col("s") + F.col("len")).cast("long").alias("end"))
    quiet = intervals.silences(speech, c.select("vec_id", F.size("embedding").cast("long").alias("n")), ["vec_id"]).where("end - start >= 4")
    out = signal.suppress(c, quiet, ["vec_id"], "embedding")
    return out.select("vec_id", F.size("embedding").cast("long").alias("n"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("kept"))


def spectrum_peak(spark, d):
    s = clips(spark, d).select("vec_id", F.explode(signal.spectrum_db(F.col("embedding"), 32, 16)).alias("frame"))
    return s.groupBy("vec_id").agg(F.count("*").alias("frames"), F.round(F.max(F.array_max("frame")), 3).alias("top_db"))


def spectrum_levels(spark, d):
    """Mean level of each frame's frequencies below the clip's loudest."""
    s = clips(spark, d).select("vec_id", F.posexplode(signal.spectrum_db(F.col("embedding"), 32, 16)).alias("k", "frame"))
    return s.select("vec_id", F.col("k").cast("long").alias("k"), F.round(F.aggregate("frame", F.lit(0.0), lambda a, x: a + x) / F.size("frame"), 3).alias("level"))


def painted_samples(spark, d):
    c = clips(spark, d).select("vec_id", F.size("embedding").cast("long").alias("n"))
    spans = c.select("vec_id", F.inline(F.array(F.struct(F.lit(0.1).alias("start"), F.lit(0.4).alias("end")), F.struct(F.lit(0.3).alias("start"), (F.col("vec_id") % 5 / 4.0).alias("end")))))
    return signal.paint_mask(spans, c, ["vec_id"], 64).groupBy("vec_id").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


def time_axes(spark, d):
    c = clips(spark, d).select("vec_id", signal.time_axis(F.col("embedding"), 64).alias("a"), signal.time_axis(F.col("embedding"), 64, F.lit(1.0)).alias("b"))
    return c.select("vec_id", F.round(F.element_at("a", -1), 6).alias("last"), F.round(F.element_at("b", -1), 6).alias("last_even"), F.round(F.aggregate("a", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def padded_pairs(spark, d):
    """Each clip's first half against the whole next clip, filled up with zeros."""
    x = signal.long_form(clips(spark, d), ["vec_id"], "embedding")
    a = x.where("i < 32").withColumnRenamed("vec_id", "pair")
    b = x.select((F.col("vec_id") - 1).alias("pair"), "i", "x").where("pair >= 0")
    out = signal.pair_signals(a, b, ["pair"], pad=True)
    return out.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.sum(F.col("a").cast("double") * F.col("b")), 6).alias("dot"))


def mono_mix(spark, d):
    c = clips(spark, d)
    other = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    mono = c.join(other, "vec_id").select("vec_id", signal.to_mono(F.array("embedding", "next")).alias("x"))
    return mono.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


QUERIES = {f.__name__: f for f in (frame_rms_tumbling, frame_rms_hopping, rms_summary, moving_rms_mask, mask_runs, topn_runs, mask_confusion, frame_confusion, best_offset, shift_mask, rms_dbfs, diff_signal, linear_resample, polyphase_resample, time_slice, centred_rms, filter_verdict, pcm16_quantise, silence_suppressed, spectrum_peak, spectrum_levels, painted_samples, time_axes, padded_pairs, mono_mix)}

X = "(SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
M = f"(SELECT vec_id, i, x, CASE WHEN x > 0 THEN 1 ELSE 0 END AS m FROM {X})"
RUNS = "SELECT vec_id, min(i) AS s, count(*) AS len FROM (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM {} WHERE m = 1) GROUP BY vec_id, g"
PAIRS = f"(SELECT a.vec_id AS pair, a.i, a.m AS a, b.m AS b FROM {M} a JOIN {M} b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)"
# The transform written out: 32 samples around each 16th, with a raised cosine, at 17 frequencies.
SPECTRUM = f"""
WITH f AS (SELECT vec_id, k, q, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i - k * 16 + 16) / 32)) * cos(2 * pi() * q * (i - k * 16 + 16) / 32)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * (i - k * 16 + 16) / 32)) * sin(2 * pi() * q * (i - k * 16 + 16) / 32)) AS im
  FROM {X} JOIN range(0, 5) f(k) ON i >= k * 16 - 16 AND i < k * 16 + 16 JOIN range(0, 17) g(q) ON TRUE GROUP BY vec_id, k, q),
z AS (SELECT *, sqrt(re * re + im * im) AS size, max(sqrt(re * re + im * im)) OVER (PARTITION BY vec_id) AS most FROM f),
s AS (SELECT vec_id, k, q, greatest(20 * log10(greatest(size, 1e-10) / greatest(most, 1e-10)), -80) AS db FROM z)"""
ORACLES = {
    "frame_rms_tumbling": f"SELECT vec_id, i // 10 AS k, round(sqrt(sum(x * x) / 10), 6) AS rms FROM {X} GROUP BY vec_id, k",
    "frame_rms_hopping": f"SELECT vec_id, CAST(k AS BIGINT) AS k, round(sqrt(sum(x * x) / 16), 6) AS rms FROM {X} JOIN range(0, 6) f(k) ON i >= k * 8 AND i < k * 8 + 16 GROUP BY vec_id, k",
    "rms_summary": f"SELECT vec_id, round(min(r), 6) AS lowest, round(quantile_cont(r, 0.5), 6) AS median, round(max(r), 6) AS highest FROM (SELECT vec_id, sqrt(sum(x * x) / 8) AS r FROM {X} GROUP BY vec_id, i // 8) GROUP BY vec_id",
    "moving_rms_mask": f"SELECT vec_id, i, CASE WHEN i = 63 THEN 0 WHEN sqrt(sum(x * x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) / 5 + 1e-12) >= 0.121 THEN 1 ELSE 0 END AS m FROM {X}",
    "mask_runs": RUNS.format(M),
    "topn_runs": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY len DESC, s) AS rank FROM ({RUNS.format(M)})) WHERE rank <= 3",
    "mask_confusion": f"""
WITH c AS (SELECT pair, CAST(sum(a * b) AS BIGINT) AS inter, CAST(sum(greatest(a, b)) AS BIGINT) AS n_union, CAST(sum(a) AS BIGINT) AS left_n, CAST(sum(b) AS BIGINT) AS right_n FROM {PAIRS} GROUP BY pair)
SELECT *, round(CASE WHEN n_union = 0 THEN 1.0 ELSE inter / n_union END, 4) AS iou, round(CASE WHEN left_n = 0 THEN 1.0 ELSE inter / left_n END, 4) AS precision, round(CASE WHEN right_n = 0 THEN 1.0 ELSE inter / right_n END, 4) AS recall,
  round(left_n * 1000.0 / CAST(64 AS DOUBLE), 1) AS left_ms, round(right_n * 1000.0 / CAST(64 AS DOUBLE), 1) AS right_ms, round((n_union - inter) * 1000.0 / CAST(64 AS DOUBLE), 1) AS symdiff_ms FROM c""",
    "frame_confusion": f"SELECT pair, count(*) AS frames, CAST(sum(a) AS BIGINT) AS left_voice, CAST(sum(b) AS BIGINT) AS right_voice, count(*) FILTER (a <> b) AS xor_frames, count(*) FILTER (a = 1 AND b = 0) AS left_only, count(*) FILTER (a = 0 AND b = 1) AS right_only FROM {PAIRS} GROUP BY pair",
    "best_offset": f"""
WITH s AS (SELECT a.vec_id AS pair, CAST(k AS BIGINT) AS shift, CAST(sum(CASE WHEN b.m = 1 THEN a.m ELSE 0 END) AS BIGINT) AS score FROM {M} a JOIN range(-8, 9) r(k) ON TRUE JOIN {M} b ON b.vec_id = a.vec_id + 1 AND b.i = a.i + k GROUP BY 1, 2)
SELECT pair, shift, score FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, shift) AS q FROM s) WHERE q = 1""",
    "shift_mask": f"SELECT vec_id, i - (vec_id % 7 - 3) AS i FROM {M} WHERE m = 1 AND i - (vec_id % 7 - 3) >= 0 AND i - (vec_id % 7 - 3) < 64",
    "rms_dbfs": f"SELECT vec_id, round(20 * log10(greatest(sqrt(avg(x * x)), 1e-12)), 4) AS dbfs, round(min(x), 6) AS lowest, round(max(x), 6) AS highest, round(avg(abs(x)), 6) AS mean_abs FROM {X} GROUP BY vec_id",
    "diff_signal": f"SELECT a.vec_id, count(*) AS n, round(sum((b.x - a.x) * (b.x - a.x)), 5) AS energy FROM {X} a JOIN {X} b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id",
    "linear_resample": f"""
WITH t AS (SELECT CAST(k AS BIGINT) AS i, CAST(floor(k * 64 / 48) AS BIGINT) AS lo, k * 64 / 48 - floor(k * 64 / 48) AS f FROM range(0, 48) r(k))
SELECT a.vec_id, t.i, round(a.x + (b.x - a.x) * f, 6) AS x FROM t JOIN {X} a ON a.i = lo JOIN {X} b ON b.vec_id = a.vec_id AND b.i = least(lo + 1, 63)""",
    "polyphase_resample": f"""
WITH t AS (SELECT {[float(t) for t in signal.filter_taps(3, 4)]} AS taps), m AS (SELECT CAST(m AS BIGINT) AS m FROM range(0, 48) r(m))
SELECT vec_id, m AS i, round(sum(x * taps[40 + m * 4 - i * 3 + 1]), 6) AS x FROM m JOIN {X} ON abs(m * 4 - i * 3) <= 40, t GROUP BY vec_id, m""",
    "time_slice": f"""
SELECT vec_id, CAST(p AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n, round(sum(x), 5) AS total FROM {X} JOIN (VALUES (0, 16, 32), (1, 0, 64), (2, 57, 64)) v(p, a, b) ON i >= a AND i < b GROUP BY vec_id, p""",
    "centred_rms": f"SELECT vec_id, CAST(k AS BIGINT) AS k, round(sqrt(sum(x * x) / 32), 6) AS rms FROM {X} JOIN range(0, 5) f(k) ON i >= k * 16 - 16 AND i < k * 16 + 16 GROUP BY vec_id, k",
    "filter_verdict": f"SELECT pair, n AS left_only, m AS right_only, CASE WHEN n > 1.2 * m THEN 'left' WHEN m > 1.2 * n THEN 'right' ELSE 'balanced' END AS verdict FROM (SELECT pair, count(*) FILTER (a = 1 AND b = 0) AS n, count(*) FILTER (a = 0 AND b = 1) AS m FROM {PAIRS} GROUP BY pair)",
    "spectrum_peak": f"{SPECTRUM} SELECT vec_id, count(DISTINCT k) AS frames, round(max(db), 3) AS top_db FROM s GROUP BY vec_id",
    "spectrum_levels": f"{SPECTRUM} SELECT vec_id, CAST(k AS BIGINT) AS k, round(avg(db), 3) AS level FROM s GROUP BY vec_id, k",
    "pcm16_quantise": f"SELECT vec_id, i, CAST(trunc(greatest(least(x * 32767, 32767.0), -32768.0)) AS BIGINT) AS v FROM {X}",
    "painted_samples": """
WITH s AS (SELECT vec_id, unnest([[6, 25], [19, least(CAST(trunc(vec_id % 5 / 4.0 * 64) AS BIGINT), len(embedding))]]) AS v FROM embeddings), i AS (SELECT DISTINCT vec_id, unnest(range(v[1], v[2])) AS i FROM s WHERE v[2] > v[1])
SELECT vec_id, count(*) AS n, min(i) AS first, max(i) AS last FROM i GROUP BY vec_id""",
    "time_axes": "SELECT vec_id, round((len(embedding) - 1) / 64, 6) AS last, 1.0::DOUBLE AS last_even, round(len(embedding) * (len(embedding) - 1) / 2 / 64, 6) AS total FROM embeddings",
    "padded_pairs": f"SELECT coalesce(a.vec_id, b.vec_id - 1) AS pair, count(*) AS n, round(sum(coalesce(a.x, 0) * coalesce(b.x, 0)), 6) AS dot FROM (SELECT * FROM {X} WHERE i < 32) a FULL JOIN (SELECT * FROM {X} WHERE vec_id > 0) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1",
    "mono_mix": f"SELECT a.vec_id, round(sum((a.x + b.x) / 2), 6) AS total FROM {X} a JOIN {X} b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id",
    "silence_suppressed": f"""
WITH m AS (SELECT vec_id, i, x, CASE WHEN x > 0.05 THEN 1 ELSE 0 END AS m FROM {X}), g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM m WHERE m = 0),
q AS (SELECT vec_id, i, count(*) OVER (PARTITION BY vec_id, g) AS len FROM g)
SELECT m.vec_id, count(*) AS n, count(*) FILTER (m.x <> 0 AND (q.len IS NULL OR q.len < 4)) AS kept FROM m LEFT JOIN q ON m.vec_id = q.vec_id AND m.i = q.i GROUP BY m.vec_id""",
}
