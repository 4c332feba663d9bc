"""Writers: CSV with a byte-order mark, fixed decimals, JSON documents, PCM files and text summaries."""

from __future__ import annotations

import csv
import io
import struct
import wave
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> bool:
    """A folder of CSV files with headers; nothing is written for an empty result."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def export_csv(df: DataFrame, path: str, limit: int = 1_000_000) -> bool:
    """One local CSV file with a byte-order mark for spreadsheets, streamed by partition; for reports of bounded size.

    A result of more than ``limit`` rows is refused rather than cut.
    """
    at, n = Path(path), 0
    plain = lambda v: "" if v is None or v != v else v
    for n, row in enumerate(df.limit(limit + 1).toLocalIterator(), 1):  # the plan runs once
        if n > limit:
            break
        if n == 1:
            out = at.open("w", encoding="utf-8-sig", newline="")
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(df.columns)
        writer.writerow([plain(v) for v in row])
    if n:
        out.close()
    if n > limit:
        at.unlink()
        raise ValueError(f"over {limit} rows: use write_csv")
    return n > 0


def fixed(df: DataFrame, names: Sequence[str], places: int = 3) -> DataFrame:
    """Numbers as text with fixed decimals."""
    return df.withColumns({c: F.format_string(f"%.{places}f", F.col(c).cast("double")) for c in names})


def write_json(df: DataFrame, path: str) -> None:
    """A JSON document for each row."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def segment_document(segments: DataFrame, keys: Sequence[str], rate: Column) -> DataFrame:
    """keys, doc: sample rate, number of segments and the segments, by start, as JSON."""
    item = F.struct("start", "end", (F.col("end") - F.col("start")).alias("duration"))
    held = segments.groupBy(*keys).agg(F.max(rate).alias("sample_rate"), F.count("*").alias("num_segments"), F.array_sort(F.collect_list(item)).alias("segments"))
    return held.select(*keys, F.to_json(F.struct("sample_rate", "num_segments", "segments")).alias("doc"))


def wav_bytes(samples: Column, rate: Column) -> Column:
    """PCM 16 file of 16-bit samples."""

    @F.pandas_udf("binary")
    def run(x: pd.Series, sr: pd.Series) -> pd.Series:
        def one(v, r) -> bytes:
            out = io.BytesIO()
            with wave.open(out, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(int(r))
                f.writeframes(np.asarray(v, "<i2").tobytes())
            return out.getvalue()

        return pd.Series([one(v, r) for v, r in zip(x, sr)])

    return run(samples, rate)


def wav_header_seconds(raw: bytes) -> float:
    """Length that a PCM file's header tells."""
    rate, width = struct.unpack_from("<I", raw, 24)[0], struct.unpack_from("<H", raw, 32)[0]
    return struct.unpack_from("<I", raw, 40)[0] / width / rate


def text_summary(df: DataFrame, lines: Sequence[tuple[str, str, str]]) -> DataFrame:
    """summary: one text for each row, a line for each (label, format, column)."""
    return df.select(F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.format_string(form, F.col(c))) for label, form, c in lines)).alias("summary"))
