"""SimHash fingerprints of whole documents, and the search of all within a Hamming radius.

Terms are hashed to as many bits as a fingerprint has; each votes with its weight
for the bits that it sets and against the others, and the sign of the sum is the
fingerprint's bit.  Terms are word shingles, with the damped weight
1 + floor(log2(times)), so that repeated lines do not drown the rest.

The search cuts fingerprints into more blocks than bits may differ, so two within
the radius agree on at least one block: one table per block, permuted to have it
first, brings such fingerprints together, and the distance decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._store import bounded_batches
from sluice.llm._text import SPACE, doc_groups, hash_words, mix, shingle_hashes, text_buffer

_U = np.uint64
#: Words in a term.
SHINGLE = 2
_LANES = np.random.Generator(np.random.PCG64(311)).integers(1, 2**64, 64, np.uint64)


def votes(terms: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Signed sum per bit of weighted term hashes."""
    total, ones = np.zeros(bits, np.int64), np.zeros(bits, np.int64)
    for w in np.unique(weights):
        own = terms[weights == w]
        for at in range(0, len(own), 255):
            h = own[at : at + 255]
            lanes = np.empty((len(h), bits // 64), np.uint64)
            for k in range(bits // 64):
                lanes[:, k] = mix(h ^ _LANES[k])
            # at most 255 rows, so a byte holds the sum
            ones += int(w) * np.unpackbits(lanes.view(np.uint8).reshape(len(h), bits // 8), axis=1).sum(axis=0, dtype=np.uint8)
        total += int(w) * len(own)
    return 2 * ones - total


def simhash(words: np.ndarray, bits: int = 256) -> bytes:
    """The fingerprint of a word-hash sequence; all zero if there is none."""
    if not len(words):
        return bytes(bits // 8)
    terms, times = np.unique(shingle_hashes(words, SHINGLE), return_counts=True)
    return np.packbits(votes(terms, np.frexp(times)[1], bits) > 0).tobytes()


def fingerprint_texts(texts: pa.Array, bits: int) -> list[bytes]:
    data, offsets = text_buffer(texts)
    out = []
    for i, j in doc_groups(offsets):
        w = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACE)
        out += [simhash(w.h[w.ptr[d] : w.ptr[d + 1]], bits) for d in range(j - i)]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprint(docs: DataFrame, *, bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (binary) of every row; null and empty texts have all bits zero.  No shuffle."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(fingerprint_texts(b.column(1), bits), pa.binary())], ["doc_id", "fingerprint"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fingerprint binary")


def near_fingerprints(queries: DataFrame, table: DataFrame, radius: int, *, bits: int = 256) -> DataFrame:
    """(query fingerprint, fingerprint, distance) of all different fingerprints of `table` within `radius` bits of one in `queries`.

    Both hold a `fingerprint` column; equal ones count once, so copies of a document
    do not multiply.  Rows without a fingerprint take no part.
    """
    blocks, words = radius + 1, bits // 32
    cut = [bits * k // blocks for k in range(blocks + 1)]

    def permuted(df: DataFrame, name: str) -> DataFrame:
        """A row per fingerprint and block: the block's number and bits, which the join is on, and the whole as 32-bit words."""
        one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        word = lambda k: F.conv(F.substring(F.hex(name), 8 * k + 1, 8), 16, 10).cast("long")
        one = one.withColumn(f"{name}_words", F.array(*[word(k) for k in range(words)]))
        spelled = F.concat(*[F.lpad(F.bin(F.get(f"{name}_words", F.lit(k))), 32, "0") for k in range(words)])
        keys = F.array(*[F.concat(F.lit(f"{k}:"), F.substring("bits", cut[k] + 1, cut[k + 1] - cut[k])) for k in range(blocks)])
        return one.withColumn("bits", spelled).select(name, f"{name}_words", F.explode(keys).alias(f"{name}_block"))

    # The distance is part of the join, so only fingerprints within the radius leave it.
    distance = " + ".join(f"bit_count(query_words[{k}] ^ near_words[{k}])" for k in range(words))
    pairs = permuted(queries, "query").join(permuted(table, "near"), F.expr(f"query_block = near_block and query <> near and {distance} <= {radius}"))
    return pairs.select("query", "near", F.expr(distance).cast("int").alias("distance")).distinct()


def with_next(docs: DataFrame, step, schema: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`step(ids, texts, next_texts)` over all documents, from the greatest id of a range to its least, each with the text of the next one (after the last: the first).

    Texts are dealt once, by ranges of ids; the first document of a range also goes to
    the range before, so that no range needs another.  A range is read from its end, so the
    next text is there before those that it follows, and no more than two are held however
    many rows share an id, or have none.  Rows that share an id have the same next document, the next larger id's with the least text; a null id
    comes before all others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn("id", F.coalesce("id", F.lit(-(2**63))))
    # `parts` numbers, however many documents: the places where ranges begin.
    ids = rows.select("id")
    cuts = sorted(set(ids.approxQuantile("id", [k / parts for k in range(parts)], 1 / (4 * parts)))) if parts > 1 else []
    low = ids.agg(F.min("id")).first()[0]
    if low is None:
        return spark.createDataFrame([], schema)
    # A range begins at an id that exists, the least at or above its cut.
    begins = sorted(r["low"] for r in ids.groupBy(_up_to([int(c) for c in cuts], F.col("id")).alias("r")).agg(F.min("id").alias("low")).collect())
    own = _up_to(begins, F.col("id")) - 1
    first = F.get(F.array(*[F.lit(b) for b in begins]), own) == F.col("id")
    at = lambda k, lent: F.struct(k.cast("int").alias("range"), F.lit(lent).alias("lent"))
    place = F.when(first, F.array(at(own, False), at(F.pmod(own - 1, F.lit(len(begins))), True))).otherwise(F.array(at(own, False)))
    dealt = rows.select("id", "text", F.explode(place).alias("to")).select("id", "text", F.col("to.range").cast("int").alias("range"), F.col("to.lent").alias("lent"))
    dealt = dealt.repartitionById(len(begins), F.col("range")).sortWithinPartitions(F.col("range"), F.col("lent").desc(), F.col("id").desc(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = first = key = None  # the next text; the least text of the id at hand
        ready = ([], [], [])

        def done():
            return step(pa.array([None if h == -(2**63) else h for h in ready[0]], pa.int64()).cast(_arrow(kind)), ready[1], ready[2])

        for b in batches:
            for i, t, lent in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("lent").to_pylist(), strict=True):
                t = t or ""
                if lent:
                    after = t if after is None else after
                    continue
                if i != key:
                    after, first, key = after if key is None else first, t, i
                for out, x in zip(ready, (i, t, after), strict=True):
                    out.append(x)
                if len(ready[0]) >= 128:
                    yield done()
                    ready = ([], [], [])
        if ready[0]:
            yield done()

    return dealt.mapInArrow(run, schema)


def _up_to(values: list[int], x: Column) -> Column:
    """How many of the sorted values are at most `x`: counted among every so many of them, then within one stretch."""
    if not values:
        return F.lit(0)
    width = max(1, int(len(values) ** 0.5))
    stretches = [values[i : i + width] for i in range(0, len(values), width)]
    count = lambda a: F.array_size(F.filter(a, lambda v: v <= x))
    k = count(F.array(*[F.lit(s[0]) for s in stretches]))
    inner = F.get(F.array(*[F.array(*[F.lit(v) for v in s]) for s in stretches]), k - 1)
    return F.when(k == 0, F.lit(0)).otherwise((k - 1) * width + count(inner))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]


def half_edited(text: str, other: str) -> str:
    """`text` with its last half replaced by the first as many code points of `other`, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edited_likeness(docs: DataFrame, *, bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null texts are empty ones: 0 characters, all bits zero.  A single document is its
    own next one.  See `with_next` for repeated and null ids; ids are whole numbers, any
    other id is an error.  An empty table gives no row; other columns are left out, whatever
    their names.  A very long text and its edited one are held in one task.
    """

    def step(ids, texts, others):
        edited = [half_edited(t, o) for t, o in zip(texts, others, strict=True)]
        n = len(texts)
        apart = [i for i in range(n) if not i or others[i] is not texts[i - 1]]  # rows come from the last id to the first
        made = fingerprint_texts(pa.array([*texts, *edited, *(others[i] for i in apart)], pa.large_string()), bits)
        own, new, after = made[:n], made[n : 2 * n], made[-1:] + made[: n - 1]
        for i, f in zip(apart, made[2 * n :], strict=True):
            after[i] = f
        columns = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([f.hex() for f in own]), pa.array([f.hex() for f in new])]
        columns += [pa.array([likeness(a, b) for a, b in zip(own, x, strict=True)], pa.float64()) for x in (new, after)]
        return pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, step, schema, id_col=id_col, text_col=text_col)
