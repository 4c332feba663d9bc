"""The folder that all executors share, for tables that cut a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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
