"""Mixing sources to target weights by temperature.

Shares of tokens are raised to a power and normalised.  Power 1 keeps them, power 0
makes all sources equal; the power is bisected to the least at which the mixture's
entropy is within its target and no source is repeated beyond its limit.  A weight
times the budget is a source's quota of tokens, met by whole epochs and a part of one
more.  In every epoch a source's documents stand in an order of their own: blocks,
permuted by hash, and within a block by hash.  The part of the last epoch is cut
where its quota ends, found by token sums of blocks, then of blocks of the block that
holds the cut, and so on; so no source's rows meet in one task, however many they are.
"""

from __future__ import annotations

from math import exp, log, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._store import discard, stored

#: Blocks that a block is cut into, as bits.
BLOCK_BITS = 8
#: Sources up to which their weights are broadcast (under 100 bytes each); more are joined.  The driver holds one number a source.
BROADCAST_SOURCES = 50_000
_NO_SOURCE = "\x00"
#: Columns that `mix` adds.
MADE = ("mix_tokens", "mix_epoch", "mix_block", "mix_order")


def words(text: Column) -> Column:
    """Number of words, as a measure of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(shares: dict[str, float], power: float) -> dict[str, float]:
    logs = {s: power * log(p) for s, p in shares.items() if p > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: exp(x - top) for s, x in logs.items()}
    total = sum(raw.values())
    return {s: raw[s] / total if s in raw else 0.0 for s in shares}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * log2(x) for x in w.values() if x > 0)


def temper(tokens: dict[str, int], budget: float, *, target_entropy: float | None = None, most_repeats: float | None = None) -> tuple[float, dict[str, float]]:
    """The power in 0..1 and the weights: the most even mixture within the entropy target (bits) and the repetition limit.

    Where even power 1 is beyond a limit, it is power 1.
    """
    total = sum(tokens.values())
    if not total:
        return 1.0, {s: 0.0 for s in tokens}
    shares = {s: t / total for s, t in tokens.items()}

    def fits(power: float) -> bool:
        w = weights(shares, power)
        if target_entropy is not None and entropy(w) > target_entropy + 1e-12:
            return False
        return most_repeats is None or all(w[s] * budget <= most_repeats * t * (1 + 1e-12) for s, t in tokens.items() if t)

    low, high = 0.0, 1.0
    if fits(low):
        return low, weights(shares, low)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high, weights(shares, high)


def _unit(seed: int, epoch: Column) -> Column:
    """A document's place in the order of an epoch: 62 bits, as good as random."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("__key")), 2)


def mix(docs: DataFrame, *, budget: int | None = None, target_entropy_share: float | None = None, most_repeats: float | None = None, tokens: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """All columns of `docs`, once per copy drawn, with mix_tokens, mix_epoch, mix_block and mix_order.

    Columns of `docs` may have any names, but those four are replaced.

    `budget` in tokens is that of the documents if not given; the entropy target is a
    share of the most that so many sources can have.  A source's tokens come within one
    document of its quota, from below.  Null sources are one source; a source without any
    tokens is drawn once.  Within a source and epoch, ascending
    mix_order is the permutation, block by block; ties of it are equal rows.  Rows that share an id keep together
    unless their texts differ; all are counted.
    """
    spark = docs.sparkSession
    kept = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in MADE}  # inside, no name of a caller's column can be one of ours
    named = [docs[c].alias(k) for c, k in kept.items()]
    counted = docs.select(*named, F.coalesce(docs[source_col].cast("string"), F.lit(_NO_SOURCE)).alias("__source"), (words(docs[text_col]) if tokens is None else tokens).alias("mix_tokens"), F.xxhash64(*[docs[c] for c in docs.columns if c in (id_col, text_col)]).alias("__key"))
    small = stored(counted.select("__source", "mix_tokens", "__key"))
    by_source = {r["__source"]: int(r["t"]) for r in small.groupBy("__source").agg(F.sum("mix_tokens").alias("t")).collect()}
    total = sum(by_source.values())
    budget = total if budget is None else budget
    target = None if target_entropy_share is None else target_entropy_share * log2(max(2, sum(t > 0 for t in by_source.values())))
    _, w = temper(by_source, budget, target_entropy=target, most_repeats=most_repeats)
    quota = {}
    for s, t in by_source.items():
        # in whole tokens; what a float falls short of a whole epoch by is no document's loss
        full, part = divmod(round(w[s] * budget), t) if t else (1, 0)
        quota[s] = (full, part)
    # From Arrow it needs no Python workers, which rows would start on executors, of a kind that no other step uses.
    columns = [pa.array(list(quota), pa.string()), pa.array([f for f, _ in quota.values()], pa.int32()), pa.array([p for _, p in quota.values()], pa.int64())]
    plan = spark.createDataFrame(pa.table(columns, ["__source", "__full", "__part"]), "__source string, __full int, __part long")

    def beside(df: DataFrame, sources: DataFrame) -> DataFrame:
        return df.join(F.broadcast(sources) if len(quota) <= BROADCAST_SOURCES else sources, "__source")

    # Documents of the last epoch whose place is below a source's cut are drawn; it is found one digit at a time.
    digits = 62 // BLOCK_BITS + 1
    placed = beside(small, plan.where("__part > 0")).withColumn("place", _unit(seed, F.col("__full"))).select("__source", "place", "mix_tokens")
    known = stored(plan.where("__part > 0").select("__source", F.lit(0).cast("long").alias("head"), F.col("__part").alias("left"), F.lit(False).alias("done")))
    for d in range(digits):
        shift = max(0, 62 - BLOCK_BITS * (d + 1))
        bits = min(BLOCK_BITS, 62 - BLOCK_BITS * d)
        here = known.where(~F.col("done"))
        if bits <= 0 or not here.limit(1).count():
            break
        inside = beside(placed, here.select("__source", "head")).where(F.shiftright("place", shift + bits) == F.col("head"))
        # At most 2**BLOCK_BITS blocks of a source; the first whose running sum is beyond what is left holds the cut.
        blocks = inside.groupBy("__source", F.shiftright("place", shift).alias("block")).agg(F.sum("mix_tokens").alias("t"), F.count("*").alias("n"))
        upto = blocks.withColumn("upto", F.sum("t").over(Window.partitionBy("__source").orderBy("block"))).join(here.select("__source", "left"), "__source")
        over = F.col("upto") > F.col("left")
        found = upto.groupBy("__source").agg(F.min(F.when(over, F.struct("block", "n"))).alias("hit"), F.max(F.when(~over, F.col("upto"))).alias("used"))
        cut, rest = F.coalesce("hit.block", F.shiftleft(F.col("head") + 1, bits)), F.col("left") - F.coalesce("used", F.lit(0))
        done = (F.coalesce("hit.n", F.lit(0)) <= 1) | (rest == 0) | F.lit(shift == 0)
        new = here.join(found, "__source", "left").select("__source", F.when(done, F.shiftleft(cut, shift)).otherwise(cut).alias("head"), rest.alias("left"), done.alias("done"))
        before, known = known, stored(known.where("done").unionByName(new))
        discard(before)
    # The cuts are those of all sources, one row each, in a small table of their own.
    cuts = stored(plan.join(known.select("__source", F.col("head").alias("__low")), "__source", "left").select("__source", "__full", F.coalesce("__low", F.lit(0)).cast("long").alias("__low")))
    discard(known)
    drawn = beside(counted, cuts)
    copies = F.col("__full") + (_unit(seed, F.col("__full")) < F.col("__low")).cast("int")
    drawn = drawn.where(copies > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    drawn = drawn.withColumn("mix_order", _unit(seed, F.col("mix_epoch")))
    return drawn.select(*[F.col(k).alias(c) for c, k in kept.items()], "mix_tokens", "mix_epoch", F.shiftright("mix_order", 62 - BLOCK_BITS).cast("int").alias("mix_block"), "mix_order")
