"""Offsets of many runs, silences, resampling and text candidates against plain Python."""

import difflib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.functions.text import common_length
from lumenspan.operators import match, signal


def runs_of(mask):
    edges = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
    return [(int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2])]


def plain_offset(a, b, most):
    n = len(a)
    best = (-1, 0)
    for sh in range(-most, most + 1):
        i = np.arange(n)
        ok = (i + sh >= 0) & (i + sh < len(b))
        score = int((a[ok] & b[i[ok] + sh]).sum())
        best = max(best, (score, -sh))
    return -best[1], best[0]


@pytest.mark.parametrize("n, most, density", [(200, 8, 0.5), (30_000, 40, 0.3), (9000, 3000, 0.01), (50, 60, 0.9), (100, 5, 0.0)])
def test_best_offset(spark, n, most, density):
    rng = np.random.default_rng(n)
    a, b = ((rng.random(n) < density).astype(int) for _ in range(2))
    a[3] = 1
    frame = lambda m: spark.createDataFrame([("k", *r) for r in runs_of(m)], "key string, s long, len long")
    got = signal.best_offset(frame(a), frame(b), ["key"], most).collect()
    assert [(r["shift"], r["score"]) for r in got] == [plain_offset(a, b, most)]


def test_best_offset_of_a_hundred_thousand_runs(spark):
    rows = spark.range(100_000).select(F.lit("k").alias("key"), (F.col("id") * 100 + F.col("id") * 37 % 40).alias("s"), (F.col("id") % 30 + 1).alias("len"))
    moved = rows.withColumn("s", F.col("s") + 777)
    began = time.time()
    got = signal.best_offset(rows, moved, ["key"], 8000).first()
    assert (got["shift"], got["score"]) == (777, rows.agg(F.sum("len")).first()[0]) and time.time() - began < 60


def test_suppressed_stretches(spark):
    rng = random.Random(1)
    clips = [(k, [float(i + 1) for i in range(n)]) for k, n in enumerate([0, 1, 50, 50, 7])]
    quiet = [(k, s, s + rng.randrange(-2, 15)) for k in (0, 1, 2, 2, 2, 2, 4) for s in [rng.randrange(-5, 55)]] + [(3, 10, 20), (3, 15, 30), (3, 30, 31), (3, 49, 99)]
    got = signal.suppress(spark.createDataFrame(clips, "k int, x array<double>"), spark.createDataFrame(quiet, "k int, start long, end long"), ["k"]).collect()
    for r in got:
        assert r.x == [0.0 if any(q[0] == r.k and q[1] <= i < q[2] for q in quiet) else v for i, v in enumerate(clips[r.k][1])]


@pytest.mark.parametrize("rates", [(64, 48), (44100, 16000), (8000, 16000), (3, 7)])
def test_resampling_is_the_written_out_sum(spark, rates):
    x = np.random.default_rng(0).normal(size=200)
    got = np.array(spark.createDataFrame([(x.tolist(),)], "x array<double>").select(signal.resample(F.col("x"), *rates)).first()[0])
    g = np.gcd(*rates)
    up, down = rates[1] // g, rates[0] // g
    taps = signal.filter_taps(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    want = np.convolve(wide, taps)[len(taps) // 2 :][: len(wide) : down]
    assert len(got) == -(-len(x) * up // down) == len(want) and np.allclose(got, want)


def test_resampling_keeps_a_tone(spark):
    x = np.sin(2 * np.pi * 440 * np.arange(4410) / 44100)
    got = np.array(spark.createDataFrame([(x.tolist(),), ([],), (None,)], "x array<double>").select(signal.resample(F.col("x"), 44100, 16000)).first()[0])
    assert np.abs(got - np.sin(2 * np.pi * 440 * np.arange(len(got)) / 16000))[200:-200].max() < 2e-3


def segments(spark, texts):
    return spark.createDataFrame([(f, k, k, 0.0, 1.0, t, t) for f, k, t in texts], "file_id string, ordinal int, index int, start double, end double, text string, norm string")


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.6])
def test_text_candidates_lose_no_match(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = ["ab", "the", "of", "cat", "dogs", "élan", "漢字", "x", "running", "aaaa"]

    def edited(t):
        t = list(t)
        for _ in range(rng.randrange(0, 1 + len(t) // 5)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "q", " "])
        return "".join(t)

    base = [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 4, 9, 60]))) for _ in range(60)] + ["", "a", "ab", "abc", "a" * 300]
    left = [(rng.choice(["hot", "hot", "b"]), k, t) for k, t in enumerate(base)]
    right = [(f, k, edited(t)) for f, k, t in left] + [("hot", 900, ""), ("hot", 901, "a")]
    a, b = segments(spark, left), segments(spark, right)
    want = {(f, i, j) for f, i, s in left for g, j, t in right if f == g and difflib.SequenceMatcher(None, s, t).ratio() >= threshold}
    met = {(r.l_file_id, r.l_ordinal, r.r_ordinal) for r in match.text_candidates(a, b, threshold).collect()}
    assert want <= met
    every = sum(f == g for f, _, _ in left for g, _, _ in right)
    assert len(met) < every / (3 if threshold > 0.8 else 1)
    best = {(r.l_file_id, r.l_ordinal): (r.r_ordinal, r.similarity) for r in match.best_text_match(a, b, threshold).collect()}
    for f, i, s in left:
        ratios = [(-difflib.SequenceMatcher(None, s, t).ratio(), j) for g, j, t in right if f == g]
        top = min(ratios)
        assert best.get((f, i)) == ((top[1], pytest.approx(-top[0])) if -top[0] >= threshold else None)


def test_files_of_few_texts_meet_directly_and_large_ones_by_the_index(spark, monkeypatch):
    """what either way gives is the best of all pairs; the plan reads what is written once, not the texts' own plan."""
    monkeypatch.setattr(match, "FEW", 3)
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", ""]
    rows = lambda n: [(f, k, k + 1, 0.0, 1.0, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for f in ("few", "few right", "many", "left only") for k in range(n if f == "many" or f == "few right" and n > 9 else 3)]
    given = rows(9), [r for r in rows(12) if r[0] != "left only"]
    a, b = (match._segments(spark.createDataFrame(x, "file_id string, ordinal int, index int, start_time double, end_time double, text string")) for x in given)
    got = match.best_text_match(a, b, 0.7)
    assert got.inputFiles() and all("/texts-" in f for f in got.inputFiles())
    best = {}
    for l in a.collect():
        for r in b.where(F.col("file_id") == l.file_id).collect():
            ratio = difflib.SequenceMatcher(None, l.norm, r.norm).ratio()
            if ratio >= 0.7:
                best[l.file_id, l.ordinal] = min(best.get((l.file_id, l.ordinal), (0, 0)), (-ratio, r.ordinal))
    assert {(r.l_file_id, r.l_ordinal): (-r.similarity, r.r_ordinal) for r in got.collect()} == best
    assert {f for f, _ in best} >= {"few right", "many"}


def test_common_length_bounds_the_matched_blocks():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcde ") for _ in range(rng.randint(0, 260))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a[:40]:
            row = step(row, x, b)
        assert common_length(a[:40], b) == row[-1]
        assert sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) <= common_length(a, b)


def step(row, x, b):
    """A row of the table of common lengths from the one before."""
    now = [0]
    for j, y in enumerate(b):
        now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
    return now
