"""Ordered scans: a hot key lies in many slices, and what is carried equals a window over the whole key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenspan.operators.scan import Slices, slice_count


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 10 < 7, F.lit("hot'\\key")).when(F.col("id") % 10 == 8, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(4000).select(key.alias("key"), F.when(F.col("id") % 97 > 0, F.col("id") * 1.7 % 991).alias("start"), "id")


def test_slices_split_a_hot_key_and_keep_the_order(spark, rows):
    cut = Slices(rows, ["key"], ["start", "id"], 8)
    held = rows.withColumn("slice", cut.number)
    of = {r.slice: r.n for r in held.groupBy("slice").agg(F.count("*").alias("n")).collect()}
    assert len(of) == 8 and max(of.values()) < 2 * 4000 / 8
    assert held.where("key LIKE 'hot%'").select("slice").distinct().count() >= 6
    order = held.orderBy("key", "start", "id").select("slice").collect()
    assert [r.slice for r in order] == sorted(r.slice for r in order)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_carried_equals_a_window_over_the_key(spark, rows, n):
    cut = Slices(rows, ["key"], ["start", "id"], n)
    held = rows.withColumn("slice", cut.number)
    last = lambda c: F.last(c, True)
    held = cut.carried(held, "slice", {"n": F.count("*"), "before": F.max_by("id", F.struct("start", "id"))}, {"n": F.sum, "before": last})
    held = cut.carried(held, "slice", {"after": F.count("*")}, {"after": F.sum}, after=True)
    own = Window.partitionBy("slice", "key").orderBy("start", "id")
    got = held.select("key", "id", (F.row_number().over(own) + F.coalesce("n", F.lit(0))).alias("k"), F.coalesce(F.lag("id").over(own), "before").alias("lag"), (F.count("*").over(Window.partitionBy("slice", "key")) + F.coalesce("n", F.lit(0)) + F.coalesce("after", F.lit(0))).alias("all"))
    whole = Window.partitionBy("key").orderBy("start", "id")
    want = rows.select("key", "id", F.row_number().over(whole).alias("k"), F.lag("id").over(whole).alias("lag"), F.count("*").over(Window.partitionBy("key")).alias("all"))
    key = lambda r: r.id
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_empty_and_small_tables(spark, rows):
    none = rows.where("id < 0")
    assert none.withColumn("slice", Slices(none, ["key"], ["start"], 4).number).count() == 0
    assert slice_count(rows) == 1
