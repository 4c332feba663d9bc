"""Queries on intervals: events that last ``value`` seconds stand for segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, match, quality
from .etl_queries import table

EPOCH = 1_700_000_000


def segments(spark, d, stretch: float = 1.0):
    e = table(spark, d, "events", "event_id", "event_type", "ts", "value")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", F.col("event_type").alias("key"), start.alias("start"), (start + F.col("value") * stretch).alias("end"))


def sides(spark, d):
    s = segments(spark, d, 10.0).withColumn("all", F.lit(1))
    return s.where("key = 'click'"), s.where("key = 'view'")


def gap_stats(spark, d):
    g = intervals.gaps(segments(spark, d), ["key"], ["event_id"])
    return g.groupBy("key").agg(F.count("gap").alias("n_gaps"), F.round(F.sum("gap"), 3).alias("total_gap"), F.round(F.max("gap"), 3).alias("longest_gap"))


def segment_quality_summary(spark, d):
    out = quality.segment_summary(segments(spark, d), ["key"], short=50.0, tiny=60.0, long=1200.0)
    return out.select("key", "n", "long_gaps", *(F.round(c, 4).alias(c) for c in ("mean_s", "median_s", "p10_s", "p90_s", "short_ratio", "gap_p10_s", "gap_median_s", "gap_p90_s", "tiny_gap_ratio", "coverage_s", "span_s")))


def gap_merge_sessions(spark, d):
    return intervals.merge_gaps(segments(spark, d), ["key"], 600.0, ["event_id"]).select("key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


def interval_overlap_join(spark, d):
    a, b = sides(spark, d)
    out = intervals.overlap_ratio_join(a, b, ["all"], 1000.0)
    return out.select("l_event_id", "r_event_id", F.round("ratio", 6).alias("ratio"))


def interval_match_class_geometry(spark, d):
    a, b = sides(spark, d)
    n = intervals.overlap_ratio_join(a, b, ["all"], 1000.0).groupBy(F.col("l_event_id").alias("event_id")).agg(F.count("*").alias("n"))
    return a.join(n, "event_id", "left").select(F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "one").otherwise("many").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def unmatched_right(spark, d):
    a, b = sides(spark, d)
    hit = intervals.overlap_ratio_join(a, b, ["all"], 1000.0).select(F.col("r_event_id").alias("event_id")).distinct()
    return b.join(hit, "event_id", "left_anti").select("event_id")


def compared(spark, d):
    s = segments(spark, d).withColumn("day", F.date_format(F.timestamp_seconds("start"), "yyyy-MM-dd"))
    return intervals.positional_compare(s.where("key = 'click'"), s.where("key = 'view'"), ["day"], ["start", "event_id"], 600_000.0)


def positional_compare(spark, d):
    return compared(spark, d).select("day", F.col("ord").cast("long").alias("ord"), "status", F.round("start_diff_ms", 1).alias("start_diff_ms"), F.round("end_diff_ms", 1).alias("end_diff_ms"))


def positional_stats(spark, d):
    out = intervals.positional_stats(compared(spark, d), ["day"])
    return out.select("day", "matched", "common", *(F.round(c, 3).alias(c) for c in ("rate_pct", "mean_start_diff_ms", "mean_end_diff_ms")))


def window_clip(spark, d):
    s = segments(spark, d)
    first = s.groupBy("key").agg(F.min("start").alias("t0"))  # a row for each key
    s = s.join(first, "key").withColumns({"start": F.col("start") - F.col("t0"), "end": F.col("end") - F.col("t0")})
    out = intervals.clip_to_window(s, 86400.0, 172800.0)
    return out.select("key", "event_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def window_overlaps(spark, d):
    """Segments with time in common with a window; those that only touch it don't count."""
    s = segments(spark, d).select("event_id", "key", F.floor("start").alias("start"), F.floor("end").alias("end"))
    first = s.groupBy("key").agg(F.min("start").alias("t0"))  # a row for each key
    s = s.join(first, "key").withColumns({"start": F.col("start") - F.col("t0"), "end": F.col("end") - F.col("t0")})
    return s.where(intervals.overlaps_window(F.col("start"), F.col("end"), F.lit(86400), F.lit(90000))).select("key", "event_id", "start", "end")


def adjacent_boundaries(spark, d):
    s = intervals.adjacent(segments(spark, d), ["key"], ["start", "event_id"], ["event_id", "start"])
    s = intervals.boundary_windows(s, "end", F.col("next_start") + 100.0, 50.0)
    return s.select("key", "event_id", "next_event_id", F.round("window_start", 3).alias("window_start"), F.round("window_end", 3).alias("window_end"))


def _clips(spark, d):
    s = segments(spark, d).select("key", (F.col("start") * 1000).cast("long").alias("start"), (F.col("end") * 1000).cast("long").alias("end"))
    base = s.groupBy("key").agg((F.min("start") - 1000).alias("t0"), F.max("end").alias("t1"))
    s = s.join(base, "key").select("key", (F.col("start") - F.col("t0")).alias("start"), (F.col("end") - F.col("t0")).alias("end"))
    return s, base.select("key", (F.col("t1") - F.col("t0") + 5000).alias("n"))


def long_silence_gaps(spark, d):
    speech, clips = _clips(spark, d)
    return intervals.silences(speech, clips, ["key"]).where("end - start >= 600000").select("key", "start", "end")


def silence_accounts(spark, d):
    speech, clips = _clips(spark, d)
    out = intervals.silence_accounts(speech, clips, ["key"], 1000.0, 600.0)
    return out.select("key", *(F.round(c, 3).alias(c) for c in ("speech_s", "long_s", "short_s")))


def speech_totals(spark, d):
    out = intervals.speech_totals(segments(spark, d), ["key"], F.lit(2_592_000.0))
    return out.select("key", F.round("speech_s", 3).alias("speech_s"), F.round("speech_pct", 6).alias("speech_pct"))


def edge_views(spark, d):
    s = segments(spark, d)
    base = s.groupBy("key").agg(F.min("start").alias("t0"))
    s = s.join(base, "key").withColumns({"start": F.col("start") - F.col("t0"), "end": F.col("end") - F.col("t0")})
    return intervals.edge_windows(s, "start", "end", F.lit(1_000_000.0)).select("event_id", *(F.round(c, 3).alias(c) for c in ("head_start", "head_end", "tail_start", "tail_end")))


def metric_compare(spark, d):
    """Sums by kind on two days, where both have the kind."""
    e = table(spark, d, "events", "ts", "event_type", "value").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    a, b = (e.where(F.col("day") == x).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.sum("value"), 2).alias("value")) for x in ("2024-01-01", "2024-01-02"))
    return match.compare_metrics(a, b).select("metric", "left", "right", F.round("diff", 2).alias("diff"))


def first_of_rounded(spark, d):
    s = segments(spark, d).select("event_id", "key", F.floor("start").cast("double").alias("start"), F.floor("start").cast("double").alias("end"))
    return intervals.keep_first_rounded(s, ["key"], "event_id", -2).groupBy("key").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


QUERIES = {f.__name__: f for f in (gap_stats, segment_quality_summary, gap_merge_sessions, interval_overlap_join, interval_match_class_geometry, unmatched_right, positional_compare, positional_stats, window_clip, window_overlaps, adjacent_boundaries, long_silence_gaps, silence_accounts, speech_totals, edge_views, metric_compare, first_of_rounded)}

S = "SELECT event_id, event_type AS key, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e FROM events"
S10 = "SELECT event_id, event_type AS key, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 10.0 AS e FROM events"
PAIRS = f"SELECT a.event_id AS l_event_id, b.event_id AS r_event_id, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) AS ratio FROM ({S10}) a JOIN ({S10}) b ON a.key = 'click' AND b.key = 'view' AND a.e > a.s AND b.e > b.s AND least(a.e, b.e) >= greatest(a.s, b.s) WHERE ratio >= 0.2"
GAPS = f"SELECT *, CASE WHEN lag(e) OVER w IS NOT NULL THEN greatest(0.0, s - lag(e) OVER w) END AS gap FROM ({S}) WINDOW w AS (PARTITION BY key ORDER BY s, e, event_id)"


def _quantile(c: str, i: int) -> str:
    """The exclusive i-th decile of a sorted list."""
    j = f"greatest(1, least({i} * (len({c}) + 1) // 10, len({c}) - 1))"
    rest = f"({i} * (len({c}) + 1) - 10 * {j})"
    return f"({c}[{j}] * (10 - {rest}) + {c}[{j} + 1] * {rest}) / 10"


COMPARED = f"""
WITH x AS (SELECT *, strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM ({S})),
o AS (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY s, event_id) - 1 AS ord FROM x),
j AS (SELECT coalesce(a.day, b.day) AS day, coalesce(a.ord, b.ord) AS ord, a.s AS ls, b.s AS rs, abs(a.s - b.s) * 1000 AS sd, abs(a.e - b.e) * 1000 AS ed
  FROM (SELECT * FROM o WHERE key = 'click') a FULL JOIN (SELECT * FROM o WHERE key = 'view') b ON a.day = b.day AND a.ord = b.ord),
c AS (SELECT *, CASE WHEN rs IS NULL THEN 'only_left' WHEN ls IS NULL THEN 'only_right' WHEN sd <= 600000 AND ed <= 600000 THEN 'match' ELSE 'differs' END AS status FROM j)"""
CLIPS = """
WITH x AS (SELECT event_type AS key, CAST(trunc(epoch_us(ts) / 1e6 * 1000) AS BIGINT) AS s, CAST(trunc((epoch_us(ts) / 1e6 + value) * 1000) AS BIGINT) AS e FROM events),
b AS (SELECT key, min(s) - 1000 AS t0, max(e) AS t1 FROM x GROUP BY key),
y AS (SELECT x.key, s - t0 AS s, e - t0 AS e FROM x JOIN b USING (key) WHERE e > s), n AS (SELECT key, t1 - t0 + 5000 AS n FROM b),
m AS (SELECT key, s, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS upto, lead(s) OVER (PARTITION BY key ORDER BY s, e) AS nxt FROM y),
q AS (SELECT m.key, upto AS s, coalesce(nxt, n) AS e FROM m JOIN n USING (key) UNION ALL SELECT key, 0, min(s) FROM y GROUP BY key), g AS (SELECT * FROM q WHERE e > s)"""
ORACLES = {
    "gap_stats": f"SELECT key, count(gap) AS n_gaps, round(sum(gap), 3) AS total_gap, round(max(gap), 3) AS longest_gap FROM ({GAPS}) GROUP BY key",
    "segment_quality_summary": f"""
WITH g AS (SELECT key, greatest(0.0, e - s) AS d, gap, s, e FROM ({GAPS})),
a AS (SELECT key, count(*) AS n, avg(d) AS mean_s, quantile_cont(d, 0.5) AS median_s, list_sort(list(d)) AS ld, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS lg,
  avg(CASE WHEN d < 50 THEN 1.0 ELSE 0 END) AS short_ratio, quantile_cont(gap, 0.5) AS gap_median_s, count(*) FILTER (gap < 60) / count(gap) AS tiny_gap_ratio,
  count(*) FILTER (gap >= 1200) AS long_gaps, sum(d) AS coverage_s, arg_max(e, {{'a': s, 'b': e}}) - min(s) AS span_s FROM g GROUP BY key)
SELECT key, n, long_gaps, round(mean_s, 4) AS mean_s, round(median_s, 4) AS median_s, round({_quantile('ld', 1)}, 4) AS p10_s, round({_quantile('ld', 9)}, 4) AS p90_s, round(short_ratio, 4) AS short_ratio,
  round({_quantile('lg', 1)}, 4) AS gap_p10_s, round(gap_median_s, 4) AS gap_median_s, round({_quantile('lg', 9)}, 4) AS gap_p90_s, round(tiny_gap_ratio, 4) AS tiny_gap_ratio, round(coverage_s, 4) AS coverage_s, round(span_s, 4) AS span_s FROM a""",
    "gap_merge_sessions": f"""
WITH x AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ({S})),
y AS (SELECT *, sum(CASE WHEN s - upto <= 600 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY s, e, event_id) AS block FROM x)
SELECT key, round(min(s), 3) AS start, round(max(e), 3) AS "end", count(*) AS n FROM y GROUP BY key, block""",
    "interval_overlap_join": f"SELECT l_event_id, r_event_id, round(ratio, 6) AS ratio FROM ({PAIRS})",
    "interval_match_class_geometry": f"WITH n AS (SELECT l_event_id, count(*) AS n FROM ({PAIRS}) GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'one' ELSE 'many' END AS class, count(*) AS n FROM events LEFT JOIN n ON l_event_id = event_id WHERE event_type = 'click' GROUP BY 1",
    "unmatched_right": f"SELECT event_id FROM events WHERE event_type = 'view' AND event_id NOT IN (SELECT r_event_id FROM ({PAIRS}))",
    "positional_compare": f"{COMPARED} SELECT day, ord, status, round(sd, 1) AS start_diff_ms, round(ed, 1) AS end_diff_ms FROM c",
    "positional_stats": f"""{COMPARED} SELECT day, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status IN ('match', 'differs')) AS common,
  round(100 * matched / nullif(common, 0), 3) AS rate_pct, round(avg(sd) FILTER (status IN ('match', 'differs')), 3) AS mean_start_diff_ms, round(avg(ed) FILTER (status IN ('match', 'differs')), 3) AS mean_end_diff_ms FROM c GROUP BY day""",
    "window_clip": f"WITH x AS (SELECT event_id, key, s - min(s) OVER (PARTITION BY key) AS s, e - min(s) OVER (PARTITION BY key) AS e FROM ({S})) SELECT key, event_id, round(greatest(s, 86400.0), 3) AS start, round(least(e, 172800.0), 3) AS \"end\" FROM x WHERE e >= 86400 AND s <= 172800",
    "window_overlaps": f"WITH y AS (SELECT event_id, key, CAST(floor(s) AS BIGINT) AS s, CAST(floor(e) AS BIGINT) AS e FROM ({S})), x AS (SELECT event_id, key, s - min(s) OVER (PARTITION BY key) AS s, e - min(s) OVER (PARTITION BY key) AS e FROM y) SELECT key, event_id, s AS start, e AS \"end\" FROM x WHERE s < 90000 AND e > 86400",
    "adjacent_boundaries": f"""WITH x AS (SELECT *, lead(event_id) OVER w AS ne, lead(s) OVER w AS ns FROM ({S}) WINDOW w AS (PARTITION BY key ORDER BY s, event_id))
SELECT key, event_id, ne AS next_event_id, round(greatest(0.0, e - 50), 3) AS window_start, round(least(ns + 100, e + 50), 3) AS window_end FROM x WHERE ne IS NOT NULL""",
    "long_silence_gaps": f'{CLIPS} SELECT key, s AS start, e AS "end" FROM g WHERE e - s >= 600000',
    "silence_accounts": f"{CLIPS}, z AS (SELECT key, sum(CASE WHEN (e - s) / 1000 >= 600 THEN (e - s) / 1000 ELSE 0 END) AS l, sum(CASE WHEN (e - s) / 1000 < 600 THEN (e - s) / 1000 ELSE 0 END) AS k FROM g GROUP BY key) SELECT key, round(n / 1000 - l - k, 3) AS speech_s, round(l, 3) AS long_s, round(k, 3) AS short_s FROM n JOIN z USING (key)",
    "edge_views": f"""WITH x AS (SELECT event_id, s - min(s) OVER (PARTITION BY key) AS s, e - min(s) OVER (PARTITION BY key) AS e FROM ({S}))
SELECT event_id, round(greatest(0.0, s - 1.5), 3) AS head_start, round(least(1000000.0, s + 4.5), 3) AS head_end, round(greatest(0.0, e - 4.5), 3) AS tail_start, round(least(1000000.0, e + 1.5), 3) AS tail_end FROM x""",
    "metric_compare": """WITH x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS metric, round(sum(value), 2) AS v FROM events GROUP BY ALL)
SELECT a.metric, a.v AS "left", b.v AS "right", round(b.v - a.v, 2) AS diff FROM x a JOIN x b ON a.metric = b.metric AND a.day = '2024-01-01' AND b.day = '2024-01-02'""",
    "first_of_rounded": f"SELECT key, count(DISTINCT round(floor(s), -2)) AS n, min(event_id) AS first FROM ({S}) GROUP BY key",
    "speech_totals": f"SELECT key, round(sum(e - s), 3) AS speech_s, round(100 * sum(e - s) / 2592000.0, 6) AS speech_pct FROM ({S}) GROUP BY key",
}
