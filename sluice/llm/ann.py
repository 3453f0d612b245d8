"""Nearest neighbours by a forest of hash-prefix trees.

The table is dealt into shards, and a shard has a forest: for each tree, the sorted
array of its vectors' hash strings.  A character of a string is the axis, with its
sign, to which a vector is nearest after a random rotation to a few dimensions.  A
query goes down every tree to where its own string would stand, as deep as a prefix
of it goes on; then all trees ascend together, a character at a time.  At every
level the vectors below a tree's node get a vote, so one that shares long prefixes, or
prefixes in many trees, has the most.  The ascent ends when enough vectors have votes;
those with the most are measured exactly, all of equal votes alike.  A shard hands on
each query's best, and the best of all shards are the result.

Equal vectors are one entry with their least ids, so a vector that is everywhere
costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trees of a forest, characters of a hash string, and dimensions of a rotation: a character has twice as many values.
TREES, CHARACTERS, DIMENSIONS = 128, 2, 16
#: Vectors of a shard, about, and queries that a shard takes at once.
SHARD, QUERY_BLOCK = 8192, 1024
#: Share of a shard's vectors that a query is measured against, and how many more for each neighbour asked for; see the README for recall.
CANDIDATES, MORE = 0.08, 6
_SAMPLE = 2048


class Forest:
    """Sorted hash strings of the rows of `x`, for every tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, characters: int = CHARACTERS, dimensions: int = DIMENSIONS, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.x, self.characters = x, characters
        self.center = x[rng.permutation(len(x))[:_SAMPLE]].mean(0)
        self.dimensions = min(dimensions, x.shape[1])
        turned = [np.linalg.qr(rng.standard_normal((x.shape[1], self.dimensions)))[0] for _ in range(trees * characters)]
        self.rotations = np.concatenate(turned, axis=1).reshape(x.shape[1], trees, characters * self.dimensions)
        self.order, self.strings = [], []
        for t in range(trees):
            s = self._hash(x, t)
            self.order.append(np.argsort(s, kind="stable"))
            self.strings.append(s[self.order[-1]])

    def _hash(self, x: np.ndarray, t: int) -> np.ndarray:
        """Strings as numbers, the first character highest."""
        turned = ((x - self.center) @ self.rotations[:, t]).reshape(len(x), self.characters, self.dimensions)
        axis = np.abs(turned).argmax(2)
        sign = np.take_along_axis(turned, axis[:, :, None], 2)[:, :, 0] > 0
        base = 2 * self.dimensions
        return (2 * axis + sign) @ base ** np.arange(self.characters - 1, -1, -1)

    def candidates(self, q: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each row of `q`, the rows of the table with the most votes, `enough` at least if there are so many."""
        base, enough = 2 * self.dimensions, min(enough, len(self.x))
        ranges = []  # of each tree, a query's node at every level
        for t, s in enumerate(self.strings):
            h = self._hash(q, t)
            low = [h // base**k * base**k for k in range(self.characters)]
            ranges.append([(np.searchsorted(s, x), np.searchsorted(s, x + base**k)) for k, x in enumerate(low)])
        for i in range(len(q)):
            votes, some = np.zeros(len(self.x), np.int32), 0
            for level in range(self.characters):
                # the longest matches first: where a tree has none of this length, its node is empty
                below = [order[r[level][0][i] : r[level][1][i]] for order, r in zip(self.order, ranges, strict=True)]
                votes += np.bincount(np.concatenate(below), minlength=len(votes)).astype(np.int32)
                some = np.count_nonzero(votes)
                if some >= enough and level:
                    break
            if some < enough:  # the root has all vectors
                yield np.arange(len(votes))
                continue
            yield np.flatnonzero(votes >= max(1, np.partition(votes, len(votes) - enough)[len(votes) - enough]))


def usable(column: Column) -> Column:
    """False for vectors that are null, empty or zero, or hold null or non-finite components."""
    value = column.cast("array<double>")
    bad = F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(value.isNotNull() & ~bad & F.exists(value, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, candidates: float = CANDIDATES, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's `k` nearest found, by Euclidean distance in double precision.

    All candidates if fewer; ties by the smaller vec_id; a query is no neighbour of its
    own id.  Unusable vectors (see `usable`), rows without an id and vectors of another
    length than the query's take no part.  Of rows that repeat an id and a vector, one counts.
    Ids are whole numbers; any other id is an error.  An empty table gives no row; other
    columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    table = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    # The k + 1 least ids of each vector: one of them may be the query's own.
    least = table.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    kinds = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    parts = max(1, -(-table.count() // shard))
    dealt = kinds.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int").alias("shard"), F.lit(False).alias("query"), "ids", "v")
    asked = queries.select(queries[id_col].cast("long").alias("id"), queries[vector_col].alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    blocks = asked.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("shard"), F.lit(True).alias("query"), F.array("id").alias("ids"), "v")
    slots = max(parts, 1)
    rows = dealt.union(blocks).repartition(slots, "dim", "shard").sortWithinPartitions("dim", "shard", "query")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, forest, waiting = None, [], [], None, []

        def answer():
            nonlocal waiting
            out = []
            if forest is not None and waiting:
                q = np.array([v for _, v in waiting], np.float64)
                enough = int(candidates * len(ids)) + MORE * k
                for (name, _), x, found in zip(waiting, q, forest.candidates(q, enough), strict=True):
                    d = np.sqrt(((forest.x[found] - x) ** 2).sum(1))
                    if len(d) > k + 1:
                        bound = np.partition(d, k)[k]
                        found, d = found[d <= bound], d[d <= bound]
                    best = sorted((s, i) for s, row in zip(d.tolist(), found.tolist(), strict=True) for i in ids[row] if i != name)[:k]
                    out += [(name, i, s) for s, i in best]
            waiting = []
            return out

        def batch(out):
            return pa.record_batch([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for b in batches:
            for dim, place, query, own, v in zip(*(b.column(c).to_pylist() for c in ("dim", "shard", "query", "ids", "v")), strict=True):
                if (dim, place) != key:
                    if waiting:
                        yield batch(answer())
                    key, ids, held, forest = (dim, place), [], [], None
                if not query:
                    ids.append(own)
                    held.append(v)
                    continue
                if forest is None and held:
                    forest, held = Forest(np.array(held, np.float64)), []
                waiting.append((own[0], v))
                if len(waiting) >= QUERY_BLOCK:
                    yield batch(answer())
        if waiting:
            yield batch(answer())

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
