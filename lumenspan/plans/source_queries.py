"""Queries through the readers and writers: files are built as texts from the tables, parsed, and compared by field."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import times
from ..operators import etl, intervals, signal
from ..sources import readers, sinks
from ..streaming import status
from .etl_queries import table

#: ASCII white space, as both engines have it.
BLANKS = r"[\x09-\x0D ]+"


def lines_of(spark, d):
    """A line for each turn that has text: conv_id, turn, and the text without line ends."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " "))
    return c.select("conv_id", "turn", flat.alias("line"), (F.col("turn") * 10.25).alias("s"))


def files(rows, key, order, text, head="", between="\n"):
    """file_id, content: the rows' texts, in order."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("x"))
    return held.select(F.col(key).cast("string").alias("file_id"), F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["t"]), between)).alias("content"))


def in_pieces(rows, key, order, text, each=1000, between="\n"):
    """The same for long files: file_id, piece, content, a piece for ``each`` values of the order."""
    cut = rows.withColumn("piece", F.floor(F.col(order) / each))
    held = cut.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("x"))
    return held.select(F.col(key).cast("string").alias("file_id"), "piece", F.array_join(F.transform("x", lambda x: x["t"]), between).alias("content"))


def _block(mark):
    clock = lambda c: F.translate(times.clock_text(c), ".", mark)
    return F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(clock(F.col("s")), F.lit(" --> "), clock(F.col("s") + 5.5)), "line")


def srt_strict(spark, d):
    out = readers.parse_srt(files(lines_of(spark, d), "conv_id", "turn", _block(","), between="\n\n"))
    return out.select(F.col("file_id").cast("long").alias("conv_id"), F.col("index").cast("long").alias("no"), "start_time", "end_time", "text")


def subtitles_lenient(spark, d):
    texts = files(lines_of(spark, d), "conv_id", "turn", _block("."), "WEBVTT\n\n", "\n\n").withColumn("file_id", F.concat("file_id", F.lit(".vtt")))
    return readers.parse_subtitles(texts).select(F.regexp_extract("file_id", r"^(\d+)", 1).cast("long").alias("conv_id"), F.col("start").alias("s"), F.col("end").alias("e"), "text")


def asr_json(spark, d):
    c = lines_of(spark, d)
    word = F.struct(F.col("s").alias("start"), F.when(F.col("turn") % 2 == 0, F.col("s") + 1).alias("end"), F.lit("w").alias("word"))
    item = F.to_json(F.struct(F.col("s").alias("start"), F.when(F.col("turn") % 3 != 0, F.col("s") + 5.5).alias("end"), F.col("line").alias("text"), F.array(word).alias("words")))
    held = files(c, "conv_id", "turn", item, '{"segments": [', ", ").withColumn("content", F.concat("content", F.lit("]}")))
    return readers.parse_asr(held).select(F.col("file_id").cast("long").alias("conv_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("start").alias("s"), F.col("end").alias("e"), "text", F.size("words").cast("long").alias("n_words"))


def events_of(spark, d):
    """Events as intervals with quarters of seconds, which print exactly."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    return e.withColumns({"s": (F.col("event_id") * 8.25), "e": (F.col("event_id") * 8.25 + F.col("event_id") % 7 + 0.5)})


def vad_log(spark, d):
    line = F.format_string("   %d: %.2fs ~ %.2fs (%.2fs)", F.col("event_id"), F.col("s"), F.col("e"), F.col("e") - F.col("s"))
    out = readers.parse_vad_log(files(events_of(spark, d), "event_type", "event_id", line, "speech\n"))
    return out.select(F.col("file_id").alias("event_type"), F.col("id").cast("long").alias("event_id"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("duration").alias("d"))


def any_vad_log(spark, d):
    """Both formats tell every event; each pair of times counts once."""
    line = F.concat(F.format_string("%d: %.2fs ~ %.2fs", F.col("event_id"), F.col("s"), F.col("e")), F.lit("\n"), F.format_string("음성 구간 %d: %.2fs ~ %.2fs (%.2fs)", F.col("event_id"), F.col("s"), F.col("e"), F.col("e") - F.col("s")))
    out = readers.parse_any_vad_log(in_pieces(events_of(spark, d), "event_type", "event_id", line))
    return out.select(F.col("file_id").alias("event_type"), F.col("ordinal").cast("long").alias("ordinal"), F.col("start").alias("s"), F.col("end").alias("e"))


def vad_totals(spark, d):
    n = events_of(spark, d).groupBy("user_id").agg((F.count("*") * 10.5).alias("total"), F.sum(F.col("e") - F.col("s")).alias("speech"))
    text = F.concat_ws("\n", F.format_string("전체: %.2fs", "total"), F.when(F.col("user_id") % 2 == 0, F.format_string("음성: %.2fs (12.5%%)", "speech")))
    out = readers.parse_vad_summary(n.select(F.col("user_id").cast("string").alias("file_id"), text.alias("content")))
    return out.select(F.col("file_id").cast("long").alias("user_id"), "total_s", "speech_s", "speech_pct", "silence_s")


def metric_lines(spark, d):
    """JSON lines, every seventh of them broken."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    whole = F.to_json(F.struct(F.col("event_type").alias("msg"), F.col("user_id").cast("string").alias("cpk"), F.col("event_id").cast("int").alias("request_count")))
    return readers.parse_metric_lines(e.select(F.when(F.col("event_id") % 7 == 0, F.lit('{"msg": ')).otherwise(whole).alias("value"))).select("msg", F.col("cpk").cast("long").alias("user_id"), F.col("request_count").cast("long").alias("event_id"))


def _chunked(spark, d):
    e = events_of(spark, d).withColumn("chunk", F.floor(F.col("event_id") / 5))
    part = e.groupBy("event_type", "chunk").agg(F.min("s").alias("a"), F.max("e").alias("b"), F.array_sort(F.collect_list(F.struct("event_id", "s", "e"))).alias("x"))
    item = F.array_join(F.transform("x", lambda x, k: F.format_string("[%d] %.2fs - %.2fs (%.2fs)", k + 1, x["s"], x["e"], x["e"] - x["s"])), "\n")
    text = F.concat_ws("\n", F.format_string("Chunk #%d", F.col("chunk") + 1), F.format_string("Time Range: %.2fs - %.2fs", "a", "b"), item)
    return readers.parse_chunks(files(part, "event_type", "chunk", text))


def chunk_listing(spark, d):
    out = _chunked(spark, d).select(F.col("file_id").alias("event_type"), F.col("chunk").cast("long").alias("chunk"), F.col("start").alias("a"), F.col("end").alias("b"), F.explode("segments").alias("x"))
    return out.select("event_type", "chunk", "a", "b", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


def chunk_with_next(spark, d):
    out = intervals.with_next(_chunked(spark, d), ["file_id"], ["chunk"], "segments")
    return out.select(F.col("file_id").alias("event_type"), F.col("chunk").cast("long").alias("chunk"), F.size("segments").cast("long").alias("n"), F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["start"]).alias("starts"))


def fixed_decimals(spark, d):
    return sinks.fixed(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice"], 3)


def segment_json(spark, d):
    segments = events_of(spark, d).select("user_id", F.col("s").alias("start"), F.col("e").alias("end"))
    doc = sinks.segment_document(segments, ["user_id"], F.lit(16000))
    kind = "sample_rate long, num_segments long, segments array<struct<start:double,end:double,duration:double>>"
    read = doc.select("user_id", F.from_json("doc", kind).alias("x")).select("user_id", "x.sample_rate", "x.num_segments", F.explode("x.segments").alias("s"))
    return read.select("user_id", "sample_rate", "num_segments", F.col("s.start").alias("s"), F.col("s.end").alias("e"), F.col("s.duration").alias("d"))


def wav_files(spark, d):
    """Vectors as 16-bit files, read back: their bytes, rate and samples."""

    @F.pandas_udf("struct<rate:long,n:long,total:double>")
    def read(raw: pd.Series) -> pd.DataFrame:
        found = [readers.wav_samples(x, False) for x in raw]
        return pd.DataFrame({"rate": [r for r, _ in found], "n": [len(x) for _, x in found], "total": [float(x.astype("float64").sum()) for _, x in found]})

    v = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", signal.pcm16(F.col("embedding")).alias("x"))
    out = v.select("vec_id", sinks.wav_bytes(F.col("x"), F.lit(8000)).alias("raw")).withColumn("r", read("raw"))
    return out.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), "r.rate", "r.n", "r.total")


def text_report(spark, d):
    n = events_of(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("speech"))
    return sinks.text_summary(n, [("Type", "%s", "event_type"), ("Events", "%d", "n"), ("Speech", "%.2f", "speech")])


def first_samples(spark, d):
    e = events_of(spark, d)
    return etl.first_rows(e, ["event_type"], ["s", "event_id"], 5).select("event_type", "event_id", "s")


def request_status(spark, d):
    """Every user's third event creates, the ones before it are polls of an unknown request."""
    e = table(spark, d, "events", "event_id", "user_id")
    made = e.withColumn("inc", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 5 * 4).cast("long"))
    return status.latest_status(made, "user_id", "event_id").select("user_id", "progress", "status")


def iso_times(spark, d):
    e = table(spark, d, "events", "event_id", "ts").withColumn("text", F.when(F.col("event_id") % 10 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return e.select("event_id", F.unix_timestamp(times.iso_time(F.col("text"))).alias("seconds"))


def padded_months(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", times.two_digits(F.month("o_orderdate")).alias("month"))


def scaled_samples(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", signal.scale_pcm(signal.pcm16(F.col("embedding"))).alias("x"))
    return v.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + F.abs(x)), 9).alias("total"))


QUERIES = {f.__name__: f for f in (srt_strict, subtitles_lenient, asr_json, vad_log, any_vad_log, vad_totals, metric_lines, chunk_listing, chunk_with_next, fixed_decimals, segment_json, wav_files, text_report, first_samples, request_status, iso_times, padded_months, scaled_samples)}

LINES = r"SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D ]+', ' ', 'g'), ' ') AS line, turn * 10.25 AS s FROM conversations"
EVENTS = "SELECT event_id, user_id, event_type, CAST(event_id * 8.25 AS DOUBLE) AS s, CAST(event_id * 8.25 + event_id % 7 + 0.5 AS DOUBLE) AS e FROM events"
CHUNKS = f"SELECT *, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY event_id // 5) - 1 AS BIGINT) AS chunk FROM ({EVENTS})"
_PCM = "greatest(least(CAST(v AS DOUBLE) * 32767, 32767.0), -32768.0)"
ORACLES = {
    "srt_strict": f"SELECT conv_id, turn + 1 AS no, CAST(s AS DOUBLE) AS start_time, CAST(s + 5.5 AS DOUBLE) AS end_time, line AS text FROM ({LINES}) WHERE line <> ''",
    "subtitles_lenient": f"SELECT conv_id, CAST(s AS DOUBLE) AS s, CAST(s + 5.5 AS DOUBLE) AS e, line AS text FROM ({LINES}) WHERE line <> '' AND NOT regexp_full_match(line, '[0-9]+')",
    "asr_json": f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s) - 1 AS ordinal, CAST(s AS DOUBLE) AS s, CAST(CASE WHEN turn % 3 <> 0 THEN s + 5.5 ELSE s END AS DOUBLE) AS e, line AS text, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n_words FROM ({LINES})",
    "vad_log": f"SELECT event_type, event_id, s, e, e - s AS d FROM ({EVENTS})",
    "any_vad_log": f"SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY s) - 1 AS ordinal, s, e FROM ({EVENTS})",
    "vad_totals": f"SELECT user_id, CAST(count(*) * 10.5 AS DOUBLE) AS total_s, CASE WHEN user_id % 2 = 0 THEN sum(e - s) END AS speech_s, CASE WHEN user_id % 2 = 0 THEN CAST(12.5 AS DOUBLE) END AS speech_pct, CAST(NULL AS DOUBLE) AS silence_s FROM ({EVENTS}) GROUP BY user_id",
    "metric_lines": "SELECT event_type AS msg, user_id, event_id FROM events WHERE event_id % 7 <> 0",
    "chunk_listing": f"SELECT event_type, chunk, min(s) OVER w AS a, max(e) OVER w AS b, s, e FROM ({CHUNKS}) WINDOW w AS (PARTITION BY event_type, chunk)",
    "chunk_with_next": f"SELECT event_type, chunk, CAST(n + coalesce(lead(n) OVER w, 0) AS BIGINT) AS n, starts + coalesce(lead(starts) OVER w, 0) AS starts FROM (SELECT event_type, chunk, count(*) AS n, sum(s) AS starts FROM ({CHUNKS}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY chunk)",
    "fixed_decimals": "SELECT o_orderkey, format('{:.3f}', o_totalprice) AS o_totalprice FROM orders",
    "segment_json": f"SELECT user_id, 16000 AS sample_rate, count(*) OVER (PARTITION BY user_id) AS num_segments, s, e, e - s AS d FROM ({EVENTS})",
    "wav_files": f"SELECT vec_id, 44 + 2 * len(embedding) AS n_bytes, 8000 AS rate, len(embedding) AS n, list_sum(list_transform(embedding, lambda v: CAST(trunc({_PCM}) AS DOUBLE))) AS total FROM embeddings",
    "text_report": f"SELECT 'Type: ' || event_type || chr(10) || 'Events: ' || count(*) || chr(10) || 'Speech: ' || format('{{:.2f}}', sum(e - s)) AS summary FROM ({EVENTS}) GROUP BY event_type",
    "first_samples": f"SELECT event_type, event_id, s FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) AS k FROM ({EVENTS})) WHERE k <= 5",
    "request_status": """
WITH e AS (SELECT *, count(*) FILTER (event_id % 3 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS round FROM events),
p AS (SELECT user_id, round, least(100, coalesce(sum(event_id % 5 * 4) FILTER (event_id % 3 <> 0), 0)) AS progress FROM e WHERE round > 0 GROUP BY 1, 2),
l AS (SELECT user_id, CAST(arg_max(progress, round) AS BIGINT) AS progress FROM p GROUP BY 1)
SELECT user_id, progress, CASE WHEN progress >= 100 THEN 'completed' WHEN progress > 0 THEN 'processing' ELSE 'pending' END AS status FROM l""",
    "iso_times": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) END AS seconds FROM events",
    "padded_months": "SELECT o_orderkey, strftime(o_orderdate, '%m') AS month FROM orders",
    "scaled_samples": f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: abs(trunc({_PCM}) / 32768.0))), 9) AS total FROM embeddings",
}
