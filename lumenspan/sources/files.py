"""Files that Spark has no format for, as data sources: CSV with a byte-order mark, PCM files out, and long PCM files in.

Writers put each task's files in a folder of the job beside their place; the driver moves them when all tasks are done and
removes the folder if the job fails, so that an aborted job leaves nothing. Paths are opened through pyarrow, so they can be
of any kind that it knows (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import csv
import io
import re
import struct
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Made(WriterCommitMessage):
    """Names that a task has written into the job's folder."""

    names: list[str]


class FolderWriter(DataSourceWriter):
    """Stages files in a folder of the job; subclasses say what ``files`` a task's rows make."""

    def __init__(self, options: dict, schema, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.names = [f.name for f in schema.fields]
        self.stage = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def files(self, rows: Iterator, task: int) -> Iterator[tuple[str, bytes]]:
        """(name, content part); parts of a name follow each other."""
        raise NotImplementedError

    def write(self, iterator) -> Made:
        store, stage = _place(self.stage)
        context = TaskContext.get()
        stage = f"{stage}/{context.taskAttemptId()}"  # an attempt's own, so that a second one can't meet it
        store.create_dir(stage, recursive=True)
        names: list[str] = []
        out = None
        try:
            for name, part in self.files(iter(iterator), context.partitionId()):
                if not names or names[-1] != name:
                    if out is not None:
                        out.close()
                    out = store.open_output_stream(f"{stage}/{name}")
                    names.append(name)
                out.write(part)
        finally:
            if out is not None:
                out.close()
        return Made([f"{context.taskAttemptId()}/{n}" for n in names])

    def commit(self, messages: list[Made | None]) -> None:
        store, path = _place(self.path)
        stage = _place(self.stage)[1]
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        store.create_dir(path, recursive=True)
        for m in messages:
            for name in m.names if m is not None else []:
                store.move(f"{stage}/{name}", f"{path}/{name.rpartition('/')[2]}")
        self._clear()

    def abort(self, messages: list[Made | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, stage = _place(self.stage)
        if store.get_file_info(stage).type != fs.FileType.NotFound:
            store.delete_dir(stage)


class CsvWriter(FolderWriter):
    """A file a task, with a byte-order mark and a header; a task without rows writes none, so an empty table gives none."""

    def files(self, rows: Iterator, task: int) -> Iterator[tuple[str, bytes]]:
        name, out = f"part-{task:05d}.csv", io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for k, row in enumerate(rows):
            if not k:
                out.write("﻿")
                writer.writerow(self.names)
            writer.writerow(["" if v is None or v != v else v for v in row])
            if out.tell() > 1 << 20:
                yield name, out.getvalue().encode()
                out.seek(0)
                out.truncate()
        if out.tell():
            yield name, out.getvalue().encode()


class WavWriter(FolderWriter):
    """A mono 16-bit file for each row (clip_id, sr, x), named after its clip; x holds 16-bit numbers."""

    def files(self, rows: Iterator, task: int) -> Iterator[tuple[str, bytes]]:
        at = {n: k for k, n in enumerate(self.names)}
        for row in rows:
            out = io.BytesIO()
            with wave.open(out, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(int(row[at["sr"]]))
                f.writeframes(np.asarray(row[at["x"]] or [], "<i2").tobytes())
            yield f"{re.sub(r'[^A-Za-z0-9._-]', '_', str(row[at['clip_id']]))}.wav", out.getvalue()


@dataclass
class Head:
    """What a PCM file's chunks tell."""

    rate: int
    channels: int
    width: int
    start: int
    size: int


def wav_head(f) -> Head:
    """Reads the chunks up to the data of an open file."""
    if f.read(12)[8:] != b"WAVE":
        raise ValueError("no WAVE file")
    rate = channels = width = 0
    while len(chunk := f.read(8)) == 8:
        name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            body = f.read(size + size % 2)
            channels, rate = struct.unpack_from("<HI", body, 2)
            width = struct.unpack_from("<H", body, 14)[0] // 8
        elif name == b"data":
            return Head(rate, channels, width, f.tell(), min(size, f.size() - f.tell()))
        else:
            f.seek(f.tell() + size + size % 2)
    raise ValueError("no data")


class Span(InputPartition):
    def __init__(self, path: str, head: Head | None, first: int, n: int) -> None:
        self.path, self.head, self.first, self.n = path, head, first, n


class WavReader(DataSourceReader):
    """A partition for each ``split_bytes`` of a file's samples, cut between frames; only heads are read to plan."""

    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split_bytes", 16 << 20))

    def partitions(self) -> list[Span]:
        store, path = _place(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.path.lower().endswith(".wav")]
        spans = []
        for x in sorted(found, key=lambda x: x.path):
            with store.open_input_file(x.path) as f:
                head = wav_head(f)
            frame = head.width * head.channels
            n, each = head.size // frame, max(1, self.split // frame)
            spans += [Span(x.path, head, k, min(each, n - k)) for k in range(0, n, each)] or [Span(x.path, head, 0, 0)]
        return spans or [Span("", None, 0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        if part.head is None:
            return
        head, frame = part.head, part.head.width * part.head.channels
        with _place(self.path)[0].open_input_file(part.path) as f:
            f.seek(head.start + part.first * frame)
            raw = f.read(part.n * frame)
        x = pcm_floats(raw, head.width, head.channels)
        arrays = [pa.array([part.path]), pa.array([head.rate], pa.int32()), pa.array([part.first], pa.int64()), pa.array([x.tolist()], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["clip_id", "sr", "first", "x"])


def pcm_floats(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples in [-1, 1] of PCM frames."""
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    return x.reshape(-1, channels).mean(1) / float(1 << (8 * width - 1))


class CsvBom(DataSource):
    """``df.write.format("csv_bom").mode("overwrite" or "append").save(path)``"""

    @classmethod
    def name(cls) -> str:
        return "csv_bom"

    def writer(self, schema, overwrite: bool) -> CsvWriter:
        return CsvWriter(self.options, schema, overwrite)


class Wav(DataSource):
    """``format("wav")``: reads clip_id, sr, first (a stretch's first sample), x; writes a file for each clip_id, sr, x."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "clip_id string, sr int, first long, x array<float>"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (CsvBom, Wav):
        spark.dataSource.register(source)


def read_long_wav(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """clip_id, sr, first, x: stretches of all PCM files of a path, each read by a task of its own."""
    register(spark)
    return spark.read.format("wav").option("split_bytes", split_bytes).load(path)


def long_form(stretches: DataFrame) -> DataFrame:
    """clip_id, sr, i, x: a row for each sample, numbered over its whole file."""
    return stretches.select("clip_id", "sr", "first", F.posexplode("x").alias("k", "x")).select("clip_id", "sr", (F.col("first") + F.col("k")).alias("i"), "x")
