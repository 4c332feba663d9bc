"""Interval algebra on literal cases and against plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import intervals, match, quality, signal

SRT = "file_id string, ordinal int, index int, start_time double, end_time double, text string"


def test_overlap_join_equals_the_nested_loop(spark):
    rng = random.Random(5)
    make = lambda: [(k, rng.choice("xy"), s := rng.uniform(-50, 300), s + rng.choice([0.0, 1.0, 5.0, 80.0]) * rng.random()) for k in range(120)]
    a, b = make(), make()
    df = lambda rows: spark.createDataFrame(rows, "id int, key string, start double, end double")
    got = {(r["l_id"], r["r_id"]) for r in intervals.overlap_ratio_join(df(a), df(b), ["key"], 7.0).collect()}
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and max(0, min(x[3], y[3]) - max(x[2], y[2])) / min(x[3] - x[2], y[3] - y[2]) >= 0.2}
    assert got == want and len(intervals.overlap_ratio_join(df(a), df(b), ["key"], 7.0).collect()) == len(want)
    assert not intervals.overlap_ratio_join(df(a).limit(0), df(b), ["key"], 7.0).collect()


def test_merge_gaps(spark):
    df = spark.createDataFrame([("f", 0.0, 2.0, "a"), ("f", 3.5, 4.0, "b"), ("f", 5.6, 6.0, "c")], "file string, start double, end double, text string")
    out = intervals.merge_gaps(df, ["file"], 1.5, text="text").orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in out] == [(0, 4, "a b"), (5.6, 6, "c")]
    again = intervals.merge_gaps(intervals.merge_gaps(df, ["file"], 1.5).drop("n", "block"), ["file"], 1.5).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in again] == [(0, 4), (5.6, 6)]


def test_positional_compare(spark):
    a = spark.createDataFrame([("f", 1.0, 2.0), ("f", 3.0, 4.0), ("f", 5.0, 6.0)], "file string, start double, end double")
    b = spark.createDataFrame([("f", 1.04, 2.01), ("f", 3.10, 4.0)], "file string, start double, end double")
    out = intervals.positional_compare(a, b, ["file"], ["start"])
    assert [r["status"] for r in out.orderBy("ord").collect()] == ["match", "differs", "only_left"]
    s = intervals.positional_stats(out, ["file"]).first()
    assert (s["matched"], s["common"], s["rate_pct"]) == (1, 2, 50.0)


def test_silences(spark):
    speech = spark.createDataFrame([("c", 12, 20), ("c", 25, 30)], "clip string, start long, end long")
    clips = spark.createDataFrame([("c", 50), ("quiet", 7)], "clip string, n long")
    rows = {(r["clip"], r["start"], r["end"]) for r in intervals.silences(speech, clips, ["clip"]).collect()}
    assert rows == {("c", 0, 12), ("c", 20, 25), ("c", 30, 50), ("quiet", 0, 7)}
    got = {r["clip"]: (r["speech_s"], r["long_s"], r["short_s"]) for r in intervals.silence_accounts(speech, clips, ["clip"], 10.0).collect()}
    assert got == {"c": pytest.approx((1.3, 3.2, 0.5)), "quiet": pytest.approx((0, 0, 0.7))}


def test_segment_summary(spark):
    rows = [("f", 0.0, 1.0), ("f", 1.1, 1.5), ("f", 1.4, 3.4), ("f", 5.0, 5.3)]
    r = quality.segment_summary(spark.createDataFrame(rows, "file string, start double, end double"), ["file"]).first()
    want = {"n": 4, "mean_s": 0.925, "median_s": 0.7, "p10_s": 0.25, "p90_s": 2.5, "gap_p10_s": -0.06, "gap_median_s": 0.1, "gap_p90_s": 2.5, "short_ratio": 0.5, "tiny_gap_ratio": 2 / 3, "long_gaps": 1, "coverage_s": 3.7, "span_s": 5.3}
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_all_six_patterns(spark):
    a = [(1, 0, 2, "Hello world."), (2, 3, 5, "good morning everyone"), (3, 6, 12, "this is a long line that will be split"), (4, 20, 22, "lost line"), (5, 30, 32, "moved line text"), (6, 40, 44, "alpha beta"), (7, 44, 48, "gamma delta")]
    b = [(1, 0.1, 2.1, "hello world"), (2, 3, 5, "good evening everybody"), (3, 6, 9, "this is a long line"), (4, 9, 12, "that will be split"), (5, 60, 62, "moved line text"), (6, 40, 44, "alpha beta"), (7, 43, 45, "xxxx"), (8, 44, 48, "gamma delta")]
    df = lambda rows: spark.createDataFrame([("f", k, i, float(s), float(e), t) for k, (i, s, e, t) in enumerate(rows)], SRT)
    out = match.classify_segments(df(a), df(b)).collect()
    got = {(r["pattern"], r["left_index"], r["right_index"], tuple(r["left_list"] or ()), tuple(r["right_list"] or ())): r for r in out}
    assert set(got) == {
        ("one_to_one", 1, 1, (), ()), ("one_to_one", 6, 6, (), ()), ("one_to_one", 7, 8, (), ()), ("text_diff_only", 2, 2, (), ()), ("split", 3, None, (), (3, 4)),
        ("missing", 4, None, (), ()), ("timeline_mismatch", 5, 5, (), ()), ("merged", None, 7, (6, 7), ()),
    }
    assert got["text_diff_only", 2, 2, (), ()]["similarity"] == pytest.approx(0.7442, abs=1e-4)
    assert got["timeline_mismatch", 5, 5, (), ()]["time_diff_s"] == 30 and got["timeline_mismatch", 5, 5, (), ()]["time_diff_ms"] == 30000
    report = match.report_json(match.transcript_diff(match.transcript_stats(df(a)), match.transcript_stats(df(b))), match.classify_segments(df(a), df(b))).first()["report"]
    assert '"timeline_mismatch":1' in report and not match.classify_segments(df([]), df([])).collect()


def runs_of(spark, bits, key="p"):
    return signal.mask_runs(spark.createDataFrame([(key, i, int(m)) for i, m in enumerate(bits)], "k string, i int, m int"), ["k"])


def test_masks(spark):
    a, b = runs_of(spark, "0011100110"), runs_of(spark, "0111001100")
    assert sorted((r["s"], r["len"]) for r in a.collect()) == [(2, 3), (7, 2)]
    assert [tuple(r) for r in signal.best_offset(a, b, ["k"], 3).collect()] == [("p", -1, 5)]
    pairs = spark.createDataFrame([("p", int(x), int(y)) for x, y in zip("0011100110", "0111001100")], "k string, a int, b int")
    r = signal.mask_confusion(pairs, ["k"]).first()
    assert (r["inter"], r["union_"], r["iou"], r["precision"], r["recall"]) == (3, 7, 0.4286, 0.6, 0.6)
    back = signal.mask_confusion(pairs.select("k", F.col("b").alias("a"), F.col("a").alias("b")), ["k"]).first()
    assert (back["iou"], back["precision"], back["recall"]) == (r["iou"], r["recall"], r["precision"])


def test_best_offset_equals_trying_all_shifts(spark):
    rng = random.Random(9)
    for _ in range(4):
        x, y = ["".join(rng.choice("0001") for _ in range(40)) for _ in range(2)]
        score = lambda s: sum(x[i] == "1" and 0 <= i + s < 40 and y[i + s] == "1" for i in range(40))  # noqa: B023, E731
        want = max(range(-9, 10), key=lambda s: (score(s), -s))
        assert tuple(signal.best_offset(runs_of(spark, x), runs_of(spark, y), ["k"], 9).first()) == ("p", want, score(want))


def test_frames_and_windows(spark):
    df = spark.createDataFrame([("c", [3.0, 4.0, 0.0, 0.0, 5.0])], "k string, x array<float>")
    assert df.select(signal.tumbling_rms(F.col("x"), 2)).first()[0] == pytest.approx([3.5355, 0, 3.5355], abs=1e-4)
    long = spark.createDataFrame([("c", [1.0] * 60), ("short", [1.0] * 20), ("none", [])], "k string, x array<float>")
    assert [len(r[0]) for r in long.select(signal.hopping_rms(F.col("x"), 20, 10)).collect()] == [4, 0, 0]
    x = signal.long_form(spark.createDataFrame([("c", [0.0, 0.0, 3.0, 0.0, 0.0, 0.0])], "k string, x array<float>"), ["k"], "x")
    mask = lambda win: "".join(str(r["m"]) for r in signal.moving_rms_mask(x, ["k"], win, 1.0).orderBy("i").collect())
    assert mask(2) == "011000" and mask(3) == "111000"


def test_signal_scalars(spark):
    df = spark.createDataFrame([([2.0, -0.5, -2.0],)], "x array<float>")
    assert df.select(signal.pcm16(F.col("x"))).first()[0] == [32767, -16383, -32768]
    assert df.select(signal.to_mono(F.array(F.col("x"), F.col("x")))).first()[0] == [2.0, -0.5, -2.0]
    ramp = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "x array<float>")
    assert ramp.select(signal.resample_linear(F.col("x"), 4, 8)).first()[0] == pytest.approx([0, 0.5, 1, 1.5, 2, 2.5, 3, 3])
    assert ramp.select(signal.level_db(F.transform("x", lambda v: v * 0))).first()[0] == pytest.approx(-240)
    assert len(ramp.select(signal.spectrum_db(F.col("x"), 4, 2)).first()[0]) == 3 and len(ramp.select(signal.centred_rms(F.col("x"), 4, 2)).first()[0]) == 3
