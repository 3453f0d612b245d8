"""Hosts against compiled tables: the longest listed suffix decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import fnv1a64
from sluice.functions.urls import domain_suffixes

#: Rows of a list up to which it is broadcast (under 40 bytes each).
BROADCAST_ROWS = 1_000_000


#: Bytes that the optimizer expects a table to have, up to which it is broadcast without being counted.
BROADCAST_BYTES = 16 << 20


def checked_broadcast(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`table` with the broadcast hint if it is small, else as it is, for a shuffled join.

    Small is what the optimizer, from the sizes of the files, expects to be so; a table
    of which it expects more is counted, and may have `most` rows.
    """
    expected = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(table) if int(str(expected)) <= BROADCAST_BYTES or table.limit(most + 1).count() <= most else table


def longest_listed(hosts: DataFrame, listed: DataFrame, host_col: str = "host", hashed: bool = True) -> DataFrame:
    """(host, matched, cat) of each distinct host that `listed` covers.

    `listed` is (h, cat) of hashed domains, or (domain, cat).  Every suffix of a host is
    looked up by one equi-join, and the longest hit is kept by a partial aggregate.
    """
    each = hosts.select(F.col(host_col).alias("host")).where("host is not null").distinct()
    each = each.select("host", F.explode(domain_suffixes("host")).alias("matched"))
    if hashed:
        each, key = each.withColumn("h", fnv1a64("matched")), "h"
    else:
        each, listed, key = each.withColumn("domain", F.col("matched")), listed, "domain"
    hit = each.join(checked_broadcast(listed.select(key, "cat")), key)
    best = F.max(F.struct(F.length("matched").alias("n"), "matched", "cat")).alias("b")
    return hit.groupBy("host").agg(best).select("host", "b.matched", "b.cat")


def covered(hosts: DataFrame, domains: DataFrame, host_col: str = "host") -> DataFrame:
    """Distinct hosts that are, or lie below, one of `domains`; a host without a dot is looked up as it is."""
    each = hosts.select(F.col(host_col).alias("host")).where("host is not null").distinct()
    lines = each.select("host", F.explode(F.array_union(F.array("host"), domain_suffixes("host"))).alias("domain"))
    return lines.join(checked_broadcast(domains.select("domain").distinct()), "domain", "left_semi").select("host").distinct()
