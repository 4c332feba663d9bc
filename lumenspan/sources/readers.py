"""Readers of subtitles, logs, JSON transcripts and audio. Each takes a path (or several) and gives a declared schema."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import clock_seconds
from ..schemas import ASR_ITEMS, METRIC_LOG

#: Tried in this order; the last never fails.
ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "euc-kr", "latin-1")


def whole_texts(spark: SparkSession, paths) -> DataFrame:
    """file_id, content: a row per file, line ends made one kind."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))


def decoded_texts(spark: SparkSession, paths) -> DataFrame:
    """As whole_texts, in the first encoding of ENCODINGS that fits."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            for e in ENCODINGS:
                try:
                    return raw.decode(e)
                except UnicodeDecodeError:
                    continue

        return values.map(one)

    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file_id"), F.regexp_replace(run("content"), "\r\n?", "\n").alias("content"))


def log_lines(spark: SparkSession, paths) -> DataFrame:
    """file_id, piece, content: a row per line, for logs too long for a task; piece orders a file's lines."""
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_id"), at.alias("piece"), F.col("value").alias("content"))


def parse_srt(texts: DataFrame) -> DataFrame:
    """Strict SRT: blocks of three lines or more with a number, a time range and text; others are left out."""
    block = texts.select("file_id", F.posexplode(F.split(F.regexp_replace("content", r"^﻿?\s+|\s+$", ""), r"\n\s*\n")).alias("ordinal", "block"))
    lines = block.withColumn("lines", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n")).where(F.size("lines") >= 3)
    times = F.split(F.get("lines", F.lit(1)), r"\s*-->\s*")
    parsed = lines.select(
        "file_id", "ordinal", F.trim(F.get("lines", F.lit(0))).try_cast("int").alias("index"), clock_seconds(F.get(times, F.lit(0))).alias("start_time"), clock_seconds(F.get(times, F.lit(1))).alias("end_time"),
        F.trim(F.array_join(F.transform(F.slice("lines", F.lit(3), F.size("lines") - 2), lambda x: F.trim(x)), " ")).alias("text"),
    )
    return parsed.where("index IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL")


STAMP = r"(\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})"


def parse_subtitles(texts: DataFrame) -> DataFrame:
    """Lenient SRT, VTT or TXT: text up to a blank line or the next time range; lines of digits and empty texts go.

    A .txt file is one segment without times. So is a file that gives no segment: all its lines but blank ones and digits.
    """
    plain = F.lower("file_id").endswith(".txt")
    stripped = F.regexp_replace("content", r"^\s+|\s+$", "")
    whole = texts.where(plain & (stripped != "")).select("file_id", F.lit(0).alias("ordinal"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), stripped.alias("text"))
    line = texts.where(~plain).select("file_id", F.posexplode(F.split("content", "\n")).alias("k", "line")).withColumn("line", F.trim("line"))
    line = line.withColumns({"stamp": F.col("line").rlike(STAMP), "digits": F.col("line").rlike(r"^\p{Nd}+$")})
    line = line.withColumn("block", F.sum(F.col("stamp").cast("int")).over(Window.partitionBy("file_id").orderBy("k")))
    line = line.withColumn("ended", F.max((F.col("line") == "").cast("int")).over(Window.partitionBy("file_id", "block").orderBy("k")))
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep & (F.col("line") != "") & ~F.col("digits"), F.struct("k", "line")))), lambda s: s["line"]), " ")
    time = lambda g: F.max(F.when(F.col("stamp"), clock_seconds(F.regexp_extract("line", STAMP, g))))
    timed = line.where("block > 0").groupBy("file_id", F.col("block").cast("int").alias("ordinal")).agg(time(1).alias("start"), time(2).alias("end"), joined(~F.col("stamp") & (F.col("ended") == 0)).alias("text")).where("text != ''")
    flat = line.join(timed.select("file_id").distinct(), "file_id", "left_anti").groupBy("file_id").agg(joined(F.lit(True)).alias("text")).where("text != ''")
    return timed.unionByName(whole).unionByName(flat.withColumn("ordinal", F.lit(0)), allowMissingColumns=True).select("file_id", "ordinal", "start", "end", "text")


def parse_asr(texts: DataFrame) -> DataFrame:
    """Verbose JSON, a list or under ``segments``: file_id, ordinal, start, end, text, words, by start and end.

    Defaults: start 0, end the start, no text, no words. Words without both times are left out.
    """
    loose = ASR_ITEMS
    items = F.coalesce(F.from_json("content", f"segments {loose}")["segments"], F.from_json("content", loose))
    row = texts.select("file_id", F.explode(items).alias("s")).where("s IS NOT NULL")
    start = F.coalesce("s.start", F.lit(0.0))
    words = F.filter(F.coalesce("s.words", F.array()), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    row = row.select("file_id", start.alias("start"), F.coalesce("s.end", start).alias("end"), F.coalesce("s.text", F.lit("")).alias("text"), words.alias("words"))
    return row.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_id").orderBy("start", "end", "text")) - 1)


def read_metric_log(spark: SparkSession, paths) -> DataFrame:
    """JSON lines; blank and broken ones are left out."""
    return spark.read.schema(METRIC_LOG + ", _corrupt_record string").json(paths, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").where("_corrupt_record IS NULL AND msg IS NOT NULL").drop("_corrupt_record")


def parse_metric_lines(lines: DataFrame, name: str = "value") -> DataFrame:
    """The same from a column of lines."""
    row = F.from_json(name, METRIC_LOG + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(row.alias("s")).select("s.*").where("_corrupt_record IS NULL AND msg IS NOT NULL").drop("_corrupt_record")


# The log formats and labels that the programs print.
NEW = r"\s(\d+):\s+([\d.]+)s\s+~\s+([\d.]+)s\s+\(([\d.]+)s\)"
OLD = r"음성\s*구간\s*(\d+):\s*([\d.]+)s\s*~\s*([\d.]+)s"
LOOSE = r"(?m)^\s*(\d+):\s*([\d.]+)s\s*~\s*([\d.]+)s"
TOTAL = r"전체:\s+([\d.]+)s"
SPEECH = r"음성:\s+([\d.]+)s\s+\(([\d.]+)%\)"
SILENCE = r"무음제거:\s+([\d.]+)s\s+\(([\d.]+)%\)"


def _found(texts: DataFrame, pattern: str, groups: int) -> DataFrame:
    names = ["id", "start", "end", "duration"][:groups]
    found = F.arrays_zip(*(F.regexp_extract_all("content", F.lit(pattern), F.lit(g + 1)).alias(n) for g, n in enumerate(names)))
    return texts.select("file_id", F.posexplode(found).alias("ordinal", "s")).select("file_id", "ordinal", F.col("s.id").cast("int").alias("id"), *(F.col(f"s.{n}").try_cast("double").alias(n) for n in names[1:]))


def parse_vad_log(texts: DataFrame) -> DataFrame:
    """file_id, ordinal, id, start, end, duration of lines like ``1: 24.49s ~ 27.22s (2.73s)``."""
    return _found(texts, NEW, 4)


def parse_any_vad_log(texts: DataFrame) -> DataFrame:
    """Segments of either log format, ends not before starts, each pair of times (to the millisecond) once, by start.

    A long file may come in pieces: rows with a column ``piece`` in the order of the text, cut at line ends where no segment
    runs on, see ``log_lines``. Then no task holds a whole file.
    """
    named = lambda p, form: F.transform(F.arrays_zip(*(F.regexp_extract_all("content", F.lit(p), F.lit(g)) for g in (2, 3))), lambda s, k: F.struct(F.lit(form).alias("form"), k.alias("ordinal"), s["0"].alias("start"), s["1"].alias("end")))
    piece = F.col("piece") if "piece" in texts.columns else F.lit(0)
    found = texts.select("file_id", piece.alias("piece"), F.inline(F.concat(named(OLD, 0), named(LOOSE, 1))))
    both = found.withColumns({n: F.col(n).try_cast("double") for n in ("start", "end")}).where(F.col("end") >= F.col("start"))
    w = Window.partitionBy("file_id", F.round("start", 3), F.round("end", 3)).orderBy("form", "piece", "ordinal")
    once = both.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return once.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("start", "end")) - 1).alias("ordinal"), "start", "end")


def parse_vad_summary(texts: DataFrame) -> DataFrame:
    """Totals that a log prints: total_s, speech_s, speech_pct, silence_s, silence_pct; null where it doesn't."""
    number = lambda p, g: F.regexp_extract("content", p, g).try_cast("double")
    named = (("total_s", TOTAL, 1), ("speech_s", SPEECH, 1), ("speech_pct", SPEECH, 2), ("silence_s", SILENCE, 1), ("silence_pct", SILENCE, 2))
    return texts.select("file_id", *(number(p, g).alias(n) for n, p, g in named))


def parse_chunks(texts: DataFrame) -> DataFrame:
    """file_id, chunk, start, end, segments of a chunk listing."""
    line = texts.select("file_id", F.posexplode(F.split("content", "\n")).alias("k", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("file_id").orderBy("k")
    line = line.withColumn("chunk", F.sum(F.col("line").startswith("Chunk #").cast("int")).over(w) - 1).where("chunk >= 0")
    number = lambda p, g: F.nullif(F.regexp_extract("line", p, g), F.lit("")).cast("double")
    span, item = r"Time Range:\s*(\d+\.?\d*)s?\s*-\s*(\d+\.?\d*)s", r"^\[\d+\]\s*(\d+\.?\d*)\s*s\s*-\s*(\d+\.?\d*)\s*s"
    segment = F.when(F.col("line").rlike(item), F.struct("k", number(item, 1).alias("start"), number(item, 2).alias("end")))
    out = line.groupBy("file_id", "chunk").agg(F.max(number(span, 1)).alias("start"), F.max(number(span, 2)).alias("end"), F.array_sort(F.collect_list(segment)).alias("s"))
    return out.select("file_id", F.col("chunk").cast("int").alias("chunk"), "start", "end", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("segments"))


def wav_samples(raw: bytes, scale: bool = True) -> tuple[int, np.ndarray]:
    """Rate and mono samples of a PCM file; ``scale`` brings them to [-1, 1]."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(f.getnframes())
    if width == 1:
        x = np.frombuffer(data, np.uint8).astype(np.float32) - 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32)
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = x.reshape(-1, channels).mean(1)
    return rate, x / float(1 << (8 * width - 1)) if scale else x


def read_wav(spark: SparkSession, paths, scale: bool = True) -> DataFrame:
    """clip_id, sr, x of PCM files."""

    @F.pandas_udf("sr int, x array<float>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav_samples(v, scale) for v in values], columns=["sr", "x"])

    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("clip_id"), run("content").alias("s")).select("clip_id", "s.sr", "s.x")


