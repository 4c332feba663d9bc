"""Scheduler-style metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .etl import pivot_count, pivot_sum, unnest_tagged

TYPES = ("balanced", "dedicated", "shared")


def metrics(log: DataFrame) -> DataFrame:
    """The metric rows of a log, with their time parsed."""
    return log.where("msg = 'metric'").withColumn("time", F.try_to_timestamp("time"))


def allocations(log: DataFrame) -> DataFrame:
    """time, cpk, count, pending, queued_at_start, total; missing numbers are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return metrics(log).where("metric_type = 'cpk_allocate' AND cpk IS NOT NULL").select(
        "time", "cpk", zero("request_count").alias("count"), zero("ongoing_count").alias("pending"), zero("queued_at_start").alias("queued_at_start"), (zero("request_count") + zero("ongoing_count")).alias("total")
    )


def batch_types(log: DataFrame) -> DataFrame:
    """time, batch_id, type, cpk: a row for each entry of the three lists."""
    return unnest_tagged(metrics(log).where("metric_type = 'batch_summary'"), {f"{t}_cpks": t for t in TYPES}, ["time", "batch_id"], "cpk")


def allocation_matrix(log: DataFrame, cpks: list[str], measures=("count", "pending", "queued_at_start", "total")) -> DataFrame:
    return pivot_sum(allocations(log), "time", "cpk", cpks, measures)


def type_matrix(log: DataFrame) -> DataFrame:
    return pivot_count(batch_types(log), "time", "type", TYPES, "cpk")
