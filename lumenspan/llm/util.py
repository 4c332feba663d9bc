"""Shared helpers: the shared folder, written intermediates and Arrow access to texts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (tests, a laptop) a temporary folder is made and named there;
    on a cluster that is an error, as executors would write to their own disks.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lumenspan-")
    sc.setCheckpointDir(made)
    return made


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove(spark: SparkSession, path: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        remove(spark, path)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder, and read it back."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The size of a plan's inputs as the optimizer has it; for files, what they take on disk. Unknown sizes count as 0."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def partitions(spark: SparkSession, n_bytes: int, each: int = 32 << 20) -> int:
    """Enough partitions for pieces of ``each`` bytes, and as many at least as the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, under fixed names, so that extra columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as its bytes and the len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, offs, data = wide.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lean(run: Callable) -> Callable:
    """The same function over batches, which gives freed memory back to the system when its task ends.

    Python workers are kept for later tasks, and the C library keeps what they freed.
    """

    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run_lean


def pieces(batches: Iterator[pa.RecordBatch], n_bytes: int = 8 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into slices with about ``n_bytes`` of text, a row at least, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + n_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
