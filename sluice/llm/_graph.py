"""Connected components of a graph in a DataFrame, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._store import discard, stored


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch, replaced by stars around the least node of each of its components."""
    for b in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while up.get(top, top) != top:
                top = up[top]
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            p, q = root(x), root(y)
            up.setdefault(x, x)
            up.setdefault(y, y)
            if p != q:
                up[max(p, q)] = min(p, q)
                up.setdefault(min(p, q), min(p, q))
        pairs = [(x, root(x)) for x in up]
        out = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node of edges (a, b), both long; a node alone has no row.

    Every round writes its edges to the shared folder.  A hub's edges are reduced to
    its least neighbour by partial aggregation, and only joined back by a join that
    Spark can split, so no node's neighbours need to meet in one task.
    """
    spark = edges.sparkSession
    now = stored(edges.select("a", "b").where("a <> b").mapInArrow(_union_find, "a long, b long").distinct())
    mark = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: of each node and its smaller neighbours, all to the least.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, stored(small)
        discard(before)
        new = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())
        if new == mark or not new[0]:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._stored_at = now._stored_at
            return out
        mark = new
