"""Session settings, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(name: str = "sluice", **settings: str) -> SparkSession:
    """A session with the engine's settings; the master and sizes are the cluster's."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in that of spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="checkpoints")  # one machine, without that setting, as in tests
        sc.setCheckpointDir(shared)
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df`, written to the folder of spark.checkpoint.dir and read back, so that its lineage ends there."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_small_batches(spark: SparkSession, default: str = "67108864b", most: str = "8m") -> None:
    """Batches go to Python by the megabyte, not by the thousand rows: a session setting, left alone where it was set."""
    if spark.conf.get(BATCH_BYTES, default) == default:
        spark.conf.set(BATCH_BYTES, most)


def spread(df: DataFrame, a_core: int = 3) -> DataFrame:
    """`df` in `a_core` tasks a core, at least.

    What is read from files comes in as few tasks as the files have row groups, however long
    each row is then worked on.  What a shuffle has dealt out stays as it is.
    """
    if df.isStreaming:
        return df
    plan, tasks = df._jdf.queryExecution(), a_core * df.sparkSession.sparkContext.defaultParallelism
    return df if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= tasks else df.repartition(tasks)
