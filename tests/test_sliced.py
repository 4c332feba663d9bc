"""One hot key over many slices: gaps, merging, silences, summaries and quantiles equal those of one slice, and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.operators import etl, intervals, quality, selection
from lumenspan.operators.scan import Slices


@pytest.fixture(scope="module")
def segments(spark):
    rng = random.Random(5)
    rows, at = [], 0.0
    for k in range(1500):
        at += rng.choice([0.0, 0.1, 0.5, 3.0, 40.0])
        rows.append(("hot" if k % 7 else rng.choice(["a", None, "b"]), round(at, 3), round(at + rng.choice([0.0, 0.2, 2.0, 60.0]), 3), k, f"t{k}"))
    return spark.createDataFrame([*rows, ("hot", 5.0, None, 9000, "open"), ("one", 1.0, 2.0, 9001, "only")], "key string, start double, end double, id long, text string").repartition(5)


def rows_of(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_a_hot_key_lies_in_many_slices(segments):
    cut = Slices(segments, ["key"], ["start", "end", "id"], 8)
    held = segments.where("key = 'hot'").groupBy(cut.number.alias("slice")).agg(F.count("*").alias("n")).collect()
    assert len(held) >= 6 and max(r.n for r in held) < 400


@pytest.mark.parametrize(
    "run",
    [
        lambda s, n: intervals.gaps(s, ["key"], ["id"], n).select("id", "gap"),
        lambda s, n: intervals.merge_gaps(s, ["key"], 1.5, ["id"], "text", n),
        lambda s, n: intervals.merge_gaps(s, ["key"], 0.0, ["id"], None, n).drop("block"),
        lambda s, n: quality.segment_summary(s, ["key"], F.col("id") % 3, slices=n),
        lambda s, n: intervals.silences(s.select("key", "start", F.coalesce("end", "start").alias("end")), s.where("key IS NOT NULL").groupBy("key").agg((F.max("end") + 7).alias("n")), ["key"], n),
    ],
)
def test_slices_change_nothing(segments, run):
    whole = rows_of(run(segments, 1))
    assert len(whole) > 3 and rows_of(run(segments, 8)) == whole == rows_of(run(segments, 3))
    assert run(segments.where("false"), 8).count() == 0


def test_merged_blocks_are_those_of_a_loop(segments):
    want = []
    by_key = {}
    for r in segments.where("key = 'hot'").collect():
        by_key.setdefault(r.key, []).append(r)
    for key, rows in by_key.items():
        upto = None
        for r in sorted(rows, key=lambda r: (r.start, r.end is not None, r.end or 0, r.id)):
            if upto is None or r.start - upto > 1.5:
                want.append([key, r.start, r.end, 0, []])
                upto = r.end if upto is None or r.end is not None else upto
            block = want[-1]
            block[3] += 1
            block[4].append(r.text)
            block[2] = max((x for x in (block[2], r.end) if x is not None), default=None)
            upto = max((x for x in (upto, r.end) if x is not None), default=None)
    got = intervals.merge_gaps(segments.where("key = 'hot'"), ["key"], 1.5, ["id"], "text", 8)
    assert rows_of(got.select("key", "start", "end", "n", "text")) == sorted([(k, s, e, n, " ".join(t)) for k, s, e, n, t in want], key=str)


@pytest.mark.parametrize("n", [1, 2, 9])
def test_quantiles_by_selection(spark, n):
    rng = np.random.default_rng(n)
    x = np.r_[np.zeros(400), rng.integers(0, 50, 300), rng.normal(size=301) * 1e6]
    rng.shuffle(x)
    df = spark.createDataFrame([(float(a), int(k % 3) if k % 5 else None, None) for k, a in enumerate(x)], "x double, y int, z double").repartition(4)
    got = {r.name: r for r in etl.describe(df, ["x", "y", "z"], n).collect()}
    y = [k % 3 for k in range(len(x)) if k % 5]
    for name, values in (("x", x), ("y", y)):
        assert [got[name].q1, got[name].q2, got[name].q3] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    assert got["z"].n == 0 and got["z"].q2 is None
    assert [r.n for r in etl.describe(df.where("false"), ["x"], n).collect()] == [0]


def test_only_slices_with_a_wanted_rank_are_sorted(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 1000).alias("v"))
    wanted = spark.createDataFrame([(0, 1), (0, 250), (1, 500), (1, 501)], "k long, rank long")
    got = selection.at_ranks(df, ["k"], "v", wanted, 8)
    assert sorted((r.k, r.rank, r.value) for r in got.collect()) == [(0, 1, 0), (0, 250, 498), (1, 500, 999)]


def test_intervals_of_very_different_lengths(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.randrange(4000)), rng.choice([0.0, 1.0, 3.0, 900.0, 5e4, 4e9, 1e12])) for k in range(250)]
    side = lambda part: spark.createDataFrame([(i, "k", s, s + d) for i, s, d in part], "id long, key string, start double, end double")
    a, b = rows[:120], rows[120:]
    want = sorted((i, j) for i, s, d in a for j, t, e in b if max(s, t) <= min(s + d, t + e))
    got = intervals.interval_join(side(a), side(b), ["key"], 1.0).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == want
    short = lambda part: [r for r in part if r[2] <= 3]
    want = sorted((i, j) for i, s, d in short(a) for j, t, e in b if max(s, t) <= min(s + d, t + e))
    assert sorted(map(tuple, intervals.interval_join(side(short(a)), side(b), ["key"], 1.0).select("l_id", "r_id").collect())) == want
