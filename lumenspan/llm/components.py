"""Connected components by alternating large-star and small-star steps; nothing is sent to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import remove, written


def components(edges: DataFrame, at: str) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b).

    A node's smallest neighbour is found by aggregation before the join, so a node that a third of all edges share costs
    one row a task; Spark splits the join's skewed side. Each round is written under ``at`` and the one before removed.
    """
    spark = edges.sparkSession
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{at}/0")
    state, k = None, 0
    while True:
        # Large star: neighbours larger than the node go to its smallest neighbour. Edges hold the larger node first.
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours smaller than the node, and the node, go to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        next_ = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        next_ = written(next_, f"{at}/{k}")
        remove(spark, f"{at}/{k - 1}")
        row = next_.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state, now = (row["n"], row["h"]), next_
    out = next_.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(out.select(F.col("component").alias("node"), "component").distinct())
