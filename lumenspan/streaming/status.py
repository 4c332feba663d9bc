"""Request states: batch and streaming forms, and log metrics in event time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.names import private

DONE = 100


def status_of(progress):
    return F.when(progress >= DONE, "completed").when(progress > 0, "processing").otherwise("pending")


def latest_status(events: DataFrame, key: str = "req_uid", order: str = "seq", inc: str = "inc") -> DataFrame:
    """key, progress, status after all events: increments add up to 100 at most; a row that creates has none.

    A key that was only polled, never created, has no state and is left out: create rows have a null increment.
    """
    w = Window.partitionBy(key).orderBy(order)
    made = F.max(F.col(inc).isNull().cast("int")).over(w)
    rows = events.select(key, order, inc)
    known, turn = private(rows, "_made"), private(rows, "_round")
    live = rows.withColumn(known, made).where(F.col(known) == 1).drop(known)
    last = live.withColumn(turn, F.sum(F.col(inc).isNull().cast("int")).over(w))  # creating again starts again
    sums = last.groupBy(key, turn).agg(F.least(F.lit(DONE), F.coalesce(F.sum(inc), F.lit(0))).cast("long").alias("progress"))
    return sums.groupBy(key).agg(F.max_by("progress", turn).alias("progress")).withColumn("status", status_of(F.col("progress")))


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rank = private(df, "_k")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


class StatusProcessor(StatefulProcessor):
    """Creates on a null increment, adds others up to 100, answers unknown keys without creating them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "progress long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        held = self.progress.get()[0] if self.progress.exists() else None
        for inc in events["inc"]:
            if pd.isna(inc):
                held = 0
            elif held is not None:
                held = min(DONE, held + int(inc))
        if held is not None:
            self.progress.update((held,))
        n = held or 0
        status = "completed" if n >= DONE else "processing" if n > 0 else "pending"
        yield pd.DataFrame({"req_uid": [key[0]], "progress": [n], "status": [status], "known": [held is not None]})

    def close(self) -> None:
        pass


def stream_status(events: DataFrame) -> DataFrame:
    """A stream of req_uid, progress, status, known: a row for each key of each batch. Needs the RocksDB state store."""
    return events.groupBy("req_uid").transformWithStateInPandas(StatusProcessor(), "req_uid string, progress long, status string, known boolean", "Update", "None")


def stream_metric_counts(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of metric rows counted by window and kind in event time."""
    rows = log.where("msg = 'metric'").withColumn("time", F.try_to_timestamp("time")).withWatermark("time", late)
    return rows.groupBy(F.window("time", window), "metric_type").agg(F.count("*").alias("n"), F.sum("request_count").alias("requests"))


def stream_sessions(segments: DataFrame, merge_window: float = 1.5, late: str = "1 minute") -> DataFrame:
    """A stream form of merge_gaps: segments (key, at, duration) that follow within ``merge_window`` seconds are one session."""
    gap = F.concat(((F.col("duration") + merge_window) * 1000).cast("long").cast("string"), F.lit(" milliseconds"))
    return segments.withWatermark("at", late).groupBy("key", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"), F.max(F.col("at").cast("double") + F.col("duration")).alias("end"))


class SessionProcessor(StatefulProcessor):
    """Holds a key's open blocks and puts out those that no row to come can reach.

    A row joins every block that it starts within the window of, or that starts within the window of it, so rows may come
    in any order until the watermark has passed. A block is done when the watermark reaches its end and the window: a row
    that starts exactly there still joins, as in merge_gaps; Spark leaves out rows that are at the watermark or before.
    """

    def __init__(self, merge_window: float) -> None:
        self.window = merge_window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "start double, end double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        blocks = [tuple(b) for b in self.blocks.get()]
        for batch in rows:
            starts = batch["at"].to_numpy("datetime64[us]").astype("int64") / 1e6
            for start, seconds in zip(starts, batch["duration"]):
                start, end, n = float(start), float(start + seconds), 1
                apart = []
                for s, e, k in blocks:
                    if start - e <= self.window and s - end <= self.window:
                        start, end, n = min(start, s), max(end, e), n + k
                    else:
                        apart.append((s, e, k))
                # What grew may now reach others.
                again = True
                while again:
                    near = [b for b in apart if start - b[1] <= self.window and b[0] - end <= self.window]
                    again = bool(near)
                    for s, e, k in near:
                        start, end, n = min(start, s), max(end, e), n + k
                    apart = [b for b in apart if b not in near]
                blocks = [*apart, (start, end, n)]
        yield self._done(key, blocks, timers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._done(key, [tuple(b) for b in self.blocks.get()], timerValues)

    def _done(self, key, blocks: list, timers) -> pd.DataFrame:
        watermark = timers.getCurrentWatermarkInMs()
        due = lambda b: math.ceil((b[1] + self.window) * 1000)
        done = sorted(b for b in blocks if due(b) <= watermark)
        left = [b for b in blocks if due(b) > watermark]
        for held in list(self.handle.listTimers()):
            self.handle.deleteTimer(held)
        if left:
            self.blocks.put(left)
            self.handle.registerTimer(min(map(due, left)))
        else:
            self.blocks.clear()
        return pd.DataFrame([(key[0], *b) for b in done], columns=["key", "start", "end", "n"]).astype({"key": object, "start": float, "end": float, "n": "int64"})

    def close(self) -> None:
        pass


def stream_merged(segments: DataFrame, merge_window: float = 1.5, late: str = "1 minute") -> DataFrame:
    """merge_gaps over a stream: key, start, end (seconds), n of finished blocks of segments (key, at, duration).

    The window is inclusive, rows may come late by ``late``, in any order. Needs the RocksDB state store.
    """
    rows = segments.select("key", "at", F.col("duration").cast("double").alias("duration")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(SessionProcessor(merge_window), "key string, start double, end double, n long", "Append", "EventTime")
