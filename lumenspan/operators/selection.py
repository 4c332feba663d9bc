"""Exact order statistics without a sort of everything: counts by slice, then only the slices that hold a wanted rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import Slices, slice_count


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, slices: int | None = None) -> DataFrame:
    """keys, rank, value: the values at the wanted ranks (from 1) among a key's sorted non-null values.

    wanted has keys and rank, some rows a key. Equal values are counted first, on the side that reads them; the different
    ones are cut in slices of their order, whatever the key, and slices without a wanted rank aren't sorted.
    """
    own = [f"k{i}" for i in range(len(keys))]
    freq = df.where(F.col(value).isNotNull()).groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cut = Slices(freq, own, ["value"], slices or slice_count(df))
    rows = freq.withColumn("slice", cut.number)
    held = rows.groupBy(*own, "slice").agg(F.sum("n").alias("held"))
    held = held.withColumn("before", F.sum("held").over(Window.partitionBy(*own).orderBy("slice")) - F.col("held"))
    of = [f"h{i}" for i in range(len(keys))]
    asked = wanted.select(*(F.col(k).alias(h) for k, h in zip(keys, of)), F.col("rank").cast("long").alias("rank")).distinct()
    hit = held.join(asked, _same(own, of)).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("held")))
    hit = hit.select(*of, F.col("slice").alias("at"), "rank", (F.col("rank") - F.col("before")).alias("local"))
    of_hit = _same([*own, "slice"], [*of, "at"])
    inside = rows.join(hit, of_hit, "left_semi")
    upto = F.sum("n").over(Window.partitionBy(*own, "slice").orderBy("value"))
    inside = inside.withColumn("upto", upto).join(hit, of_hit).where((F.col("upto") - F.col("n") < F.col("local")) & (F.col("local") <= F.col("upto")))
    return inside.select(*(F.col(o).alias(k) for o, k in zip(own, keys)), "rank", "value")


def quantiles(df: DataFrame, names: Sequence[str], shares: Sequence[float], slices: int | None = None) -> DataFrame:
    """name, and q1, q2, ...: exact quantiles of numeric columns, between two values in proportion; null without values."""
    tall = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select("x.*")
    place = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(shares)))
    sizes = tall.groupBy("name").agg(F.count("value").alias("n")).where("n > 0").select("name", F.explode(place).alias("p")).select("name", "p.i", "p.at")
    wanted = sizes.select("name", F.explode(F.array(F.floor("at") + 1, F.ceil("at") + 1)).alias("rank"))
    found = at_ranks(tall, ["name"], "value", wanted, slices).withColumnRenamed("name", "of")  # a few rows a column
    low, high = F.floor("at") + 1, F.ceil("at") + 1
    part = sizes.join(found, (F.col("name") == F.col("of")) & F.col("rank").isin(low, high))
    a, b = F.max(F.when(F.col("rank") == low, F.col("value"))), F.max(F.when(F.col("rank") == high, F.col("value")))
    each = part.groupBy("name", "i", "at").agg(a.alias("a"), b.alias("b")).withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return each.groupBy("name").agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i + 1}") for i in range(len(shares))))
