"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a single machine where that is unset, as in tests, a new local one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once and read back: later readers, and tasks run again after a lost executor, see the same rows."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and nothing reads any more: whatever was made of them must itself be stored by now."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, default: str = "67108864b", most: str = "8m") -> None:
    """Batches of texts go to Python by the megabyte, not by the thousand rows: a session setting, left alone where it was set."""
    if spark.conf.get(_BATCH, default) == default:
        spark.conf.set(_BATCH, most)
