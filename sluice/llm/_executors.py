"""What executors keep between the stages of a pipeline."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def give_back(spark: SparkSession) -> None:
    """Every executor collects its heap once: what the stage before made it grow by goes back to the system.

    A Java heap shrinks at a full collection only, and Python workers need memory beside
    it.  One task an executor, as Spark deals tasks without a place in turn; one that gets
    none, as it is busy, keeps its heap until the next call.
    """
    # the driver is listed too; alone, it is the executor
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
