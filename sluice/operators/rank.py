"""Numbering rows in a global order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.plans.session import stored


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """`df` with its 0-based place in the order; ties in any order.

    Rows are dealt by ranges of the order; a row's place is that in its range and the
    number of rows in the ranges before, of which there are as many as partitions.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    by = [F.col(k).asc_nulls_last() for k in keys]
    dealt = stored(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*by)))
    return ranked.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__part", "__before", "__row", *keys)
