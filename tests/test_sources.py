"""Readers, sinks, the paged source, HTML and streaming on temporary files."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import intervals, logs
from lumenspan.plans import source_queries
from lumenspan.sources import crawl, files, html, readers, rest, sinks
from lumenspan.streaming import status


def texts(spark, *contents):
    return spark.createDataFrame([(n, c) for n, c in contents], "file_id string, content string")


def test_strict_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:19,200 --> 00:00:21,000\nHello world.\nagain\n\nx\n00:00:22,000 --> 00:00:23,000\nbad\n\n3\n00:00:24,000 --> 00:00:25,500")
    out = readers.parse_srt(readers.whole_texts(spark, str(tmp_path))).collect()
    assert [(r["index"], r["start_time"], r["end_time"], r["text"]) for r in out] == [(1, 19.2, 21.0, "Hello world. again")]


def test_lenient_subtitles(spark):
    df = texts(spark, ("a.vtt", "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\n12\nhello\nthere\n\nlost\n2\n00:00:03,000 --> 00:00:04,000\nbye"), ("b.txt", "plain\n\ntext"), ("c.srt", "no times\nat all"))
    rows = {(r["file_id"], r["start"], r["end"], r["text"]) for r in readers.parse_subtitles(df).collect()}
    assert rows == {("a.vtt", 1.0, 2.5, "hello there"), ("a.vtt", 3.0, 4.0, "bye"), ("b.txt", None, None, "plain\n\ntext"), ("c.srt", None, None, "no times at all")}


def test_asr_json(spark):
    a = json.dumps([{"start": 2, "text": "b"}, {"start": 1, "end": 1.5, "text": "a", "words": [{"start": 1, "end": 1.2, "word": "a"}, {"start": 1}]}])
    out = readers.parse_asr(texts(spark, ("a", a), ("b", json.dumps({"segments": [{}]})), ("c", "broken"))).orderBy("file_id", "ordinal").collect()
    assert [(r["file_id"], r["start"], r["end"], r["text"], len(r["words"])) for r in out] == [("a", 1.0, 1.5, "a", 1), ("a", 2.0, 2.0, "b", 0), ("b", 0.0, 0.0, "", 0)]


def test_vad_logs(spark):
    df = texts(spark, ("a", "   1: 24.49s ~ 27.22s (2.73s)\n음성 구간 2: 10.20s ~ 15.40s (5.20s)\n   3: 24.4900s ~ 27.22s\n음성 구간 4: 1.0s ~ 2.0s\n전체: 153.92s\n음성:   89.30s (58.0%)"))
    assert [(r["id"], r["start"], r["end"], r["duration"]) for r in readers.parse_vad_log(df).orderBy("ordinal").collect()] == [(1, 24.49, 27.22, 2.73), (2, 10.2, 15.4, 5.2)]
    assert [(r["start"], r["end"]) for r in readers.parse_any_vad_log(df).orderBy("ordinal").collect()] == [(1.0, 2.0), (10.2, 15.4), (24.49, 27.22)]
    s = readers.parse_vad_summary(df).first()
    assert (s["total_s"], s["speech_s"], s["speech_pct"], s["silence_s"]) == (153.92, 89.3, 58.0, None)


def test_chunks(spark):
    out = readers.parse_chunks(texts(spark, ("a", "Chunk #1\nTime Range: 0.00s - 12.50s\n[1] 0.50s - 3.25s (2.75s)\nChunk #2\nTime Range: 12.5s - 20.0s"))).orderBy("chunk").collect()
    assert [(r["chunk"], r["start"], r["end"], [tuple(s) for s in r["segments"]]) for r in out] == [(0, 0.0, 12.5, [(0.5, 3.25)]), (1, 12.5, 20.0, [])]


def test_vad_log_in_pieces(spark, tmp_path):
    """a long log is read by lines or pieces, never as one row; what is equal to the millisecond is the first one's."""
    lines = ["음성 구간 1: 5.0s ~ 6.0s", "음성 구간 2: 10.2001s ~ 15.4s", "음성 구간 3: 10.2002s ~ 15.4s (5.20s)", "  1: 1.0s ~ 2.0s", "2: 5.0001s ~ 6.0s", "no segment", "3: 9.0s ~ 8.0s"]
    told = [(0, 1.0, 2.0), (1, 5.0, 6.0), (2, 10.2001, 15.4)]
    given = lambda df: [(r["ordinal"], r["start"], r["end"]) for r in readers.parse_any_vad_log(df).orderBy("ordinal").collect()]
    parts = spark.createDataFrame([("a", k, "\n".join(part)) for k, part in ((1, lines[2:4]), (0, lines[:2]), (2, lines[4:]))], "file_id string, piece int, content string")
    assert given(texts(spark, ("a", "\n".join(lines)))) == given(parts) == told
    (tmp_path / "a.log").write_text("\n".join(lines), encoding="utf-8")
    assert given(readers.log_lines(spark, str(tmp_path))) == told


def test_vad_log_query_holds_no_whole_file(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, k % 7, "click") for k in range(5000)], "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen, parse = [], readers.parse_any_vad_log
    monkeypatch.setattr(readers, "parse_any_vad_log", lambda df: (seen.append(df), parse(df))[1])
    out = source_queries.any_vad_log(spark, str(tmp_path))
    assert out.count() == 5000 and out.agg(F.max("ordinal")).first()[0] == 4999
    assert seen[0].count() == 5 and seen[0].agg(F.max(F.length("content"))).first()[0] < 150_000


def test_metric_log_and_pivots(spark, tmp_path):
    lines = [
        {"msg": "metric", "time": "2024-01-01T00:00:00", "metric_type": "cpk_allocate", "cpk": "k1", "request_count": 2}, {"msg": "metric", "time": "2024-01-01T00:00:00", "metric_type": "cpk_allocate", "cpk": "k1", "request_count": 3, "ongoing_count": 1},
        {"msg": "metric", "time": "2024-01-01T00:01:00", "metric_type": "cpk_allocate", "cpk": "k2", "request_count": 4}, {"msg": "other"}, {"msg": "metric", "time": "2024-01-01T00:01:00", "metric_type": "batch_summary", "batch_id": "b", "balanced_cpks": ["k1", "k2"]},
    ]
    (tmp_path / "log.json").write_text("\n".join([*map(json.dumps, lines), "", "{broken"]))
    log = readers.read_metric_log(spark, str(tmp_path))
    assert log.count() == 5
    rows = logs.allocation_matrix(log, ["k1", "k2"], ["count", "pending"]).orderBy("time").collect()
    assert [(r["k1_count"], r["k1_pending"], r["k2_count"]) for r in rows] == [(5, 1, 0), (0, 0, 4)]
    assert [tuple(r)[1:] for r in logs.type_matrix(log).collect()] == [(2, 0, 0)]
    stream = status.stream_metric_counts(spark.readStream.schema(log.schema).json(str(tmp_path)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("metric_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("metric_counts").agg(F.sum("n")).first()[0] == 4


def test_wav_round_trip(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.array([[0, 0], [16384, 16384], [-32768, 0]], "<i2").tobytes())
    df = readers.read_wav(spark, str(tmp_path / "a.wav"))
    r = df.first()
    assert r["sr"] == 8000 and r["x"] == pytest.approx([0, 0.5, -0.5])
    raw = df.select(sinks.wav_bytes(F.transform("x", lambda v: (v * 32767).cast("short")), F.col("sr"))).first()[0]
    assert readers.wav_samples(bytes(raw))[0] == 8000 and sinks.wav_header_seconds(bytes(raw)) == 3 / 8000


def test_encodings(spark, tmp_path):
    (tmp_path / "k.txt").write_bytes("음성 1: 1.0s ~ 2.0s".encode("cp949"))
    assert readers.decoded_texts(spark, str(tmp_path)).first()["content"].startswith("음성")


def test_articles(spark):
    block = '<div class="sds-comps-vertical-layout x"><span class="sds-comps-text-type-headline1">A <mark>b</mark> &amp; c</span><span class="sds-comps-text-type-body1">sum</span></div>'
    profile = '<div data-sds-comp="Profile"><span class="sds-comps-text-type-body2 sds-comps-text-weight-sm">press</span><span class="sds-comps-profile-info-subtext"><a><span class="sds-comps-text">2일 전</span></a></span></div>'
    page = f'{profile}{block}<span class="sds-comps-text-type-headline1">D<br></span><script>x</script></p>'
    out = html.articles(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "html", ["id"]).collect()
    assert [tuple(r)[1:] for r in out] == [(0, "Ab& c", "press", "2일 전", "sum"), (1, "D", *(html.MISSING[k] for k in ("press", "date", "summary")))]
    assert spark.createDataFrame([(page,)], "html string").select(html.texts(F.col("html"), "div mark")).first()[0] == ["b"]


def pages(first, last, filters):
    if first == 5 and filters.get("year") == "broken":
        raise OSError("no network")
    return json.dumps({"svc": {"list_total_count": 7, "RESULT": {"CODE": "INFO-000"}, "row": [{"a": str(k), "b": "x"} for k in range(first, last + 1)]}})


def test_paged_source(spark):
    spark.dataSource.register(rest.paged_source("paged_test", pages, "svc"))
    assert sorted(r["a"] for r in rest.read_pages(spark, "paged_test", ["a", "b"], 2).collect()) == list("1234567")


def test_paged_source_stops_at_the_first_failure(spark):
    def failing(first, last, filters):
        if first == 3:
            raise OSError("no network")
        return pages(first, last, filters)

    spark.dataSource.register(rest.paged_source("paged_failing", failing, "svc"))
    assert sorted(r["a"] for r in rest.read_pages(spark, "paged_failing", ["a"], 2).collect()) == ["1", "2"]
    assert sorted(r["a"] for r in rest.read_pages(spark, "paged_failing", ["a"], 2, stop_at_failure=False).collect()) == ["1", "2", "5", "6", "7"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "가, b")], "n int, t string")
    assert sinks.export_csv(df, str(tmp_path / "a.csv")) and (tmp_path / "a.csv").read_bytes().startswith(b"\xef\xbb\xbfn,t\n1,")
    assert not sinks.export_csv(df.limit(0), str(tmp_path / "b.csv")) and not (tmp_path / "b.csv").exists()
    assert sinks.write_csv(df, str(tmp_path / "c")) and spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
    assert sinks.fixed(spark.range(1).select((F.col("id") + 1.23456).alias("x")), ["x"]).first()["x"] == "1.235"
    doc = sinks.segment_document(spark.createDataFrame([("c", 1.0, 2.5)], "clip string, start double, end double"), ["clip"], F.lit(16000)).first()["doc"]
    assert json.loads(doc) == {"sample_rate": 16000, "num_segments": 1, "segments": [{"start": 1.0, "end": 2.5, "duration": 1.5}]}
    sinks.write_json(df, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).first()[0]) == {"n": 1, "t": "가, b"}


EVENTS = [(1, "r", None), (2, "r", 20), (3, "r", 20), (4, "r", 20), (5, "r", 20), (6, "u", 5)]


def test_status_batch(spark):
    df = lambda rows: spark.createDataFrame(rows, "seq long, req_uid string, inc int")
    got = lambda rows: [tuple(r) for r in status.latest_status(df(rows)).collect()]
    assert got(EVENTS) == [("r", 80, "processing")]
    assert got([*EVENTS, (7, "r", 20), (8, "r", 20)]) == [("r", 100, "completed")]


def test_status_stream(spark, tmp_path):
    rows = spark.createDataFrame(EVENTS, "seq long, req_uid string, inc int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = status.stream_status(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("statuses").collect()} == {("r", 80, "processing", True), ("u", 0, "pending", False)}


def test_paged_source_asks_for_year_and_month(spark):
    def yearly(first, last, filters):
        if filters != {"year": "2024", "month": "03"}:
            raise OSError("asked for everything")
        return pages(first, last, {})

    spark.dataSource.register(rest.paged_source("paged_yearly", yearly, "svc"))
    assert rest.read_pages(spark, "paged_yearly", ["a"], 3, year="2024", month="03").count() == 7


def logged(path, *told):
    """Tasks may be processes of their own, so requests are told in a file."""
    with open(path, "a") as f:
        f.write(json.dumps(told) + "\n")


def requests(path):
    return sorted(path.read_text().splitlines()) if path.exists() else []


@pytest.mark.parametrize("broken", [None, 5])
def test_every_page_is_requested_once(spark, tmp_path, broken):
    at = tmp_path / "log"

    def counted(first, last, filters):
        logged(at, first, last)
        if first == broken:
            raise OSError("no network")
        return pages(first, last, {})

    name = f"paged_counted_{broken}"
    spark.dataSource.register(rest.paged_source(name, counted, "svc"))
    out = rest.read_pages(spark, name, ["a"], 2, keep=str(tmp_path / "kept"))
    assert sorted(r["a"] for r in out.collect()) == list("1234567")[: 7 if broken is None else 4]
    assert out.count() and requests(at) == sorted(json.dumps(x) for x in ([1, 1], [1, 2], [3, 4], [5, 6], [7, 7]))


def monthly(path):
    def run(first, last, filters):
        logged(path, first, last, filters["year"], filters["month"])
        year, month = int(filters["year"]), int(filters["month"])
        if (year, month) == (2016, 2) or (year, month, first) == (2017, 3, 3):
            raise OSError("no network")
        total = 0 if month == 12 else month % 5
        return json.dumps({"svc": {"list_total_count": total, "RESULT": {"CODE": "INFO-000"}, "row": [{"a": f"{year}-{month}-{k}"} for k in range(first, min(last, total) + 1)]}})

    return run


def test_all_months_in_one_scan(spark, tmp_path):
    """120 months, each a partition: every request once, a failure ends its month alone."""
    at = tmp_path / "log"
    spark.dataSource.register(rest.monthly_source("months_all", monthly(at), "svc"))
    df = rest.read_months(spark, "months_all", ["a"], page_size=2)
    got = sorted(r["a"] for r in df.collect())
    want = [f"{y}-{m}-{k}" for y in range(2015, 2025) for m in range(1, 12) for k in range(1, m % 5 + 1) if (y, m) != (2016, 2) and not ((y, m) == (2017, 3) and k >= 3)]
    assert got == sorted(want)
    made = requests(at)
    assert len(made) == len(set(made)) and sum('[1, 1, ' in x for x in made) == 120
    assert df.rdd.getNumPartitions() == 120


@pytest.mark.parametrize("condition, n", [("year IN (2016, 2018) AND month = 3", 2), ("year >= 2020 AND year < 2022 AND month > 10", 4), ("year = 2024 AND month <= 2", 2), ("year > 2024", 0)])
def test_months_are_chosen_by_pushed_predicates(spark, tmp_path, condition, n):
    at, name = tmp_path / "log", f"months_{abs(hash(condition))}"
    spark.dataSource.register(rest.monthly_source(name, monthly(at), "svc", pushdown=True))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format(name).option("page_size", 10).load().where(condition).collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sum("[1, 1, " in x for x in requests(at)) == n
    assert {(r.year, r.month) for r in rows} <= {(r.year, r.month) for r in spark.createDataFrame([(y, m) for y in range(2015, 2025) for m in range(1, 13)], "year int, month int").where(condition).collect()}


def test_crawl_tells_and_skips_failing_pages(spark, tmp_path):
    at = tmp_path / "log"

    def fetch(start):
        logged(at, start)
        if start == 11 or start == 31 and sum(x == "[31]" for x in requests(at)) < 2:
            raise OSError("no network")
        return f'<article><h1>page {start}</h1><p>text</p></article>'

    spark.dataSource.register(crawl.crawl_source("crawl_test", fetch))
    got = crawl.crawl(spark, "crawl_test", pages=4, retries=2)
    rows = {r.page: r for r in got.collect()}
    assert [rows[k].attempts for k in (1, 2, 3, 4)] == [1, 3, 1, 2] and rows[2].error == "OSError: no network" and rows[2].html is None
    kept = html.articles(got.where("error IS NULL"), "html", ["page"], {"title": "article h1", "around": "article", "summary": "p"})
    assert sorted((r.page, r.title) for r in kept.collect()) == [(1, "page 1"), (3, "page 21"), (4, "page 31")]


def test_fetched_rows_of_a_table(spark):
    def fetch(row):
        if row["url"] is None:
            raise ValueError("no address")
        return row["url"].upper()

    got = crawl.fetched(spark.createDataFrame([(1, "a"), (2, None)], "id long, url string"), fetch, retries=1).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1, None, "A"), (2, None, 2, "ValueError: no address", None)]


def test_csv_writer_commits_and_aborts(spark, tmp_path):
    files.register(spark)
    df = spark.range(100).select("id", F.concat(F.lit("가, "), "id").alias("t")).repartition(3)
    out = tmp_path / "csv"
    df.write.format("csv_bom").mode("overwrite").save(str(out))
    parts = sorted(out.iterdir())
    assert len(parts) == 3 and all(p.read_bytes().startswith(b"\xef\xbb\xbfid,t\n") for p in parts)
    assert sorted(int(line.split(",")[0]) for p in parts for line in p.read_text("utf-8-sig").splitlines()[1:]) == list(range(100))
    with pytest.raises(Exception, match="broken on purpose"):
        df.select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken on purpose")).cast("string")).otherwise("t").alias("t")).write.format("csv_bom").mode("overwrite").save(str(out))
    assert sorted(out.iterdir()) == parts  # the earlier files, and no staged ones
    df.limit(0).write.format("csv_bom").mode("overwrite").save(str(out))
    assert list(out.iterdir()) == []


def test_wav_writer_and_long_files(spark, tmp_path):
    files.register(spark)
    rng = np.random.default_rng(0)
    long = rng.integers(-32768, 32767, 50_001).astype("<i2")
    rows = spark.createDataFrame([("a b/c", 8000, [1, -2, 3]), ("none", 8000, [])], "clip_id string, sr int, x array<short>")
    rows.write.format("wav").mode("append").save(str(tmp_path / "w"))
    want = b"RIFF" + (36 + 6).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") * 2 + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little") + b"data" + (6).to_bytes(4, "little") + np.array([1, -2, 3], "<i2").tobytes()
    assert (tmp_path / "w" / "a_b_c.wav").read_bytes() == want and (tmp_path / "w" / "none.wav").stat().st_size == 44
    with wave.open(str(tmp_path / "w" / "long.wav"), "wb") as f:
        f.setnchannels(3)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(long.tobytes())
    df = files.read_long_wav(spark, str(tmp_path / "w"), 5000)
    assert df.where("clip_id LIKE '%long.wav'").count() == 21
    got = [r.x for r in files.long_form(df).where("clip_id LIKE '%long.wav'").orderBy("i").collect()]
    whole = readers.read_wav(spark, str(tmp_path / "w" / "long.wav")).first().x
    assert got == whole and len(got) == 16_667


def test_sessions_of_a_stream_are_merged_gaps(spark, tmp_path):
    """Replayed in three orders and batches, late rows included: the blocks of merge_gaps."""
    import random

    from pyspark.sql import types as T

    rng = random.Random(3)
    rows, at = [], 1_700_000_000.0
    for k in range(120):
        at += rng.choice([0.0, 1.5, 1.6, 4.0, 20.0])
        rows.append((rng.choice("ab"), at, rng.choice([0.0, 0.5, 3.0])))
    rows.append(("a", rows[0][1] + 1.5, 0.0))  # touches the window's edge
    schema = T.StructType().add("key", "string").add("s", "double").add("duration", "double")
    batch = spark.createDataFrame(rows, schema).select("key", F.col("s").alias("start"), (F.col("s") + F.col("duration")).alias("end"))
    want = sorted((r.key, round(r.start, 3), round(r.end, 3), r.n) for r in intervals.merge_gaps(batch, ["key"], 1.5).collect())
    for order in range(2):
        at = tmp_path / str(order)
        for k in range(0, len(rows), 30):  # each batch shuffled; the watermark allows for a batch's reach
            part = rows[k : k + 30]
            random.Random(order).shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(at / "in"))
        spark.createDataFrame([("end", rows[-2][1] + 1e6, 0.0)], schema).coalesce(1).write.mode("append").parquet(str(at / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
        out = status.stream_merged(stream.select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("at"), "duration"), 1.5, "1 hour")
        q = out.writeStream.outputMode("append").format("memory").queryName(f"merged_{order}").option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted((r.key, round(r.start, 3), round(r.end, 3), r.n) for r in spark.table(f"merged_{order}").collect())
        assert got == want


def test_counts_and_sessions_of_a_metric_log(spark, tmp_path):
    rows = spark.createDataFrame([("k", "2024-01-01T00:00:00", 1.0), ("k", "2024-01-01T00:00:02", 1.0), ("k", "2024-01-01T00:00:09", 1.0)], "key string, t string, duration double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).select("key", F.to_timestamp("t").alias("at"), "duration")
    q = status.stream_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("session_windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("session_windows").collect()) == [1, 2]
