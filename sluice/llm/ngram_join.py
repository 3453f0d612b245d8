"""Jaccard self-join of documents on their word n-gram sets, and its connected components.

Documents with equal sets are one node.  Any two sets at the threshold share an
n-gram among the first few of each in any common order; the order is rare-first:
by how many sets hold an n-gram, as far as it is frequent at all, then by hash.
Frequent n-grams are found by mergeable counters over all documents, with a list
whose length the total bounds.

The list of a prefix n-gram keeps a set only if another one in it is of a fitting
size, then only if one passes the positional filter with it, then their bitmaps:
chance meetings, which grow with the square of the texts, end before more than an
entry is known of them.

Sets that share a prefix n-gram are brought together, and pass the length filter
and the positional filter, which bounds the overlap by what precedes and follows
the shared n-gram in both.  Each set also has a small bitmap of parities: two sets
differ in at least as many n-grams as their bitmaps in bits, so most pairs end there,
before whole sets are sent.  A suffix filter compares the sets by halves, and each
pair that is left is verified once on whole sets.

A group of thousands of near copies would make a pair for each two of them.  So
pairs are verified in rounds: each set with the closest, by bitmap, of those near it
in the lists of its rarest n-grams, a few for each set; what these links join is then
one component.  Later rounds take up only pairs across components, in more lists and
among other neighbours, as long as they join much.  The last step takes up all pairs
across components that are left.  Links within a component do not change it, so the
components are those of all links.

In the last step the shorter set of a pair comes with the first n-grams that it could
lack and one more, which are fewer than its prefix.  An n-gram of a set's prefix
that no other prefix has is not in any set whose prefix reaches as far, so each
set knows how many of its n-grams another one surely lacks up to some places in the
order.  That ends pairs of long texts that share a passage and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._graph import components
from sluice.llm._store import bounded_batches, discard, stored
from sluice.llm._text import LOWER, doc_groups, hash_words, shingle_hashes, text_buffer
from sluice.llm._worker import trimmed

#: Counters of one task; what it forgets of an n-gram is at most its n-grams divided by this.
COUNTERS = 1 << 17
#: Entries of the list of frequent n-grams: those in more than this share of all. 16 bytes each.
FREQUENT = 1 << 22
#: Rows of candidates up to which their ids are broadcast (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Sets in the list of an n-gram beyond which it is dealt in parts, as far as its count is known.
LONGEST_LIST = 1024
#: Entries by size after one of a list that are looked at for a partner, beyond which all of the list stay; rows from which a list is not gathered.
PARTNERS, GATHERED = 64, 1 << 15
#: Bits of a set's bitmap.
BITMAP = 1024
#: In the rounds: lists of each set in the first one and in later ones, by rarity; entries before it in a list that a set is held against; those of them that it is verified with.
LISTS, MORE_LISTS, STRETCH, NEIGHBOURS = 4, 16, 64, 2
#: Links that a round must find for another one to follow.
WORTH_A_ROUND = 1000
#: Places in the order, as shares of all hashes in units of (1 - threshold), up to which n-grams that others lack are counted.
PLACES = (0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 4.5)


def gram_sets(texts: pa.Array, n: int, fold: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text.  A text of fewer words has one, the whole sequence; one without words has none."""
    data, offsets = text_buffer(texts)
    for i, j in doc_groups(offsets):
        w = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold=LOWER if fold else None)
        for d in range(j - i):
            yield np.unique(shingle_hashes(w.h[w.ptr[d] : w.ptr[d + 1]], n))


def signature(grams: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def parities(grams: np.ndarray) -> np.ndarray:
    """For each of BITMAP hash slots, whether an odd number of n-grams falls in it."""
    slots = np.bincount((grams & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP)
    return np.packbits((slots & 1).astype(bool)).view(np.int64)


def wide_parities(grams: np.ndarray) -> bytes:
    """Parities in at least four slots per n-gram, a power of two; what a set's small bitmap cannot tell if it is long."""
    slots = max(BITMAP, 1 << int(4 * len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Slots whose parities differ; the wider bitmap is folded to the width of the other."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def merged(h: np.ndarray, c: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters with the n-grams `new` added; if more than `most` are left, all give up the count of the first one too many."""
    if len(new):
        g, k = np.unique(new, return_counts=True)
        h, inverse = np.unique(np.concatenate([h, g]), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([c, k]), len(h)).astype(np.int64)
    if len(h) > most:
        c = c - np.partition(c, len(c) - most - 1)[len(c) - most - 1]
        h, c = h[c > 0], c[c > 0]
    return h, c


class Threshold:
    """Integer forms of |x & y| >= t |x | y|."""

    def __init__(self, t: Fraction):
        self.t = t

    def links(self, overlap, a, b):
        return self.t.denominator * overlap >= self.t.numerator * (a + b - overlap)

    def overlap(self, a, b):
        """Least overlap of linked sets of sizes a and b."""
        p, q = self.t.numerator, self.t.denominator
        return -(-p * (a + b) // (p + q))

    def prefix(self, n: int) -> int:
        return n - -(-self.t.numerator * n // self.t.denominator) + 1


def _describe(n: int, fold: bool):
    """doc_id, size and signature of each text's set; at the end, the task's counters (no doc_id, no signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names = ["doc_id", "size", "sig", "bits", "grams", "counts"]
        none = pa.nulls(1, pa.binary())
        seen: set[bytes] = set()
        for b in batches:
            sizes, sigs, bits, new, held = [], [], [], [], 0
            for s in gram_sets(b.column("text"), n, fold):
                sizes.append(len(s))
                sigs.append(signature(s) if len(s) else None)
                bits.append(parities(s) if len(s) else None)
                if len(s) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    new.append(s)
                    held += len(s)
                if held > 1 << 19:
                    h, c = merged(h, c, np.concatenate(new), COUNTERS)
                    new, held = [], 0
            if new:
                h, c = merged(h, c, np.concatenate(new), COUNTERS)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.nulls(len(sizes), pa.binary()), pa.nulls(len(sizes), pa.binary())], names)
        more = c > 1  # what a task saw once tells nothing of frequency
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), none, pa.nulls(1, pa.list_(pa.int64())), pa.array([h[more].tobytes()], pa.binary()), pa.array([c[more].tobytes()], pa.binary())], names)

    return run


def _frequent(described: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that tasks counted in more than total / FREQUENT sets: fewer than FREQUENT, since counts add up to the total at most."""

    def unpack(batches):
        for b in batches:
            for g, c in zip(b.column("grams").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(g, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["gram", "n"])

    counted = described.where("size < 0").select("grams", "counts").mapInArrow(unpack, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > max(2, total // FREQUENT)).toArrow()
    g, n = (rows[c].to_numpy().astype(np.int64) for c in ("gram", "n"))
    g = g.view(np.uint64)
    order = np.argsort(g)
    return g[order], n[order]


class Order:
    """Rare-first order of n-grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(grams >> np.uint64(42)).astype(np.int64)] = True

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams in order, with their counts, 0 if they are not frequent."""
        count = np.zeros(len(s), np.int64)
        known = np.flatnonzero(self.maybe[(s >> np.uint64(42)).astype(np.int64)])
        if not len(known):
            return s, count
        at = np.minimum(np.searchsorted(self.grams, s[known]), len(self.grams) - 1)
        count[known] = np.where(self.grams[at] == s[known], self.counts[at], 0)
        order = np.argsort(count, kind="stable")  # s is sorted by hash
        return s[order], count[order]


def _places(threshold: Threshold) -> np.ndarray:
    """PLACES as the upper halves of hashes; the last one is beyond all."""
    return np.array([int(min(1.0, x * float(1 - threshold.t)) * (1 << 32)) for x in PLACES] + [1 << 32], np.int64)


def _prefixes(order, threshold: Threshold, n: int, fold: bool, longest: int):
    """(gram, part, sig, size, pos, reach) of the prefix of each set, once per task and set; reach is the number of places that the whole prefix reaches.

    The list of an n-gram that is known in more than `longest` sets is in parts, by
    signature; where it is whole, part is -1, or -2 if the n-gram is a frequent one.
    """

    def batch(rows):
        grams, parts, sigs, sizes, pos, reach = rows
        return pa.record_batch([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(parts)), pa.array(sigs, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(reach))], ["gram", "part", "sig", "size", "pos", "reach"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, places = Order(*order.value), _places(threshold)
        seen: set[bytes] = set()
        rows, held = ([], [], [], [], [], []), 0
        for b in batches:
            for s in gram_sets(b.column("text"), n, fold):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                k = threshold.prefix(len(s))
                grams, counts = (x[:k] for x in rare.sort(s))
                own = int.from_bytes(sig[:4])
                rows[0].append(grams)
                rows[1].append(np.where(counts > longest, own % (counts // longest + 1), np.where(counts > 0, -2, -1)).astype(np.int32))
                rows[2].extend([sig] * k)
                rows[3].append(np.full(k, len(s), np.int32))
                rows[4].append(np.arange(k, dtype=np.int32))
                last = int(grams[-1]) >> 32 if not counts[-1] else 1 << 32  # frequent n-grams come after all places
                rows[5].append(np.full(k, np.searchsorted(places, last, "right"), np.int8))
                held += k
                if held > 1 << 16:
                    yield batch(rows)
                    rows, held = ([], [], [], [], [], []), 0
        if held:
            yield batch(rows)

    return run


def _with_partner(t: pa.Table, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of lists sorted by size, whether another one in its list has a fitting size, and whether one passes the positional filter, and that of bitmaps where there are some, too.

    Entries of lists in parts, and of long lists as far as they are in doubt, have both.
    """
    p, q = threshold.t.numerator, threshold.t.denominator
    gram, part, size, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("gram", "part", "size", "pos"))
    bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(gram), -1) if "bits" in t.column_names else None
    fits = part >= 0
    passes = fits.copy()
    cuts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]), [True]]))
    end = np.repeat(cuts[1:], np.diff(cuts))
    i = np.arange(len(gram))
    for k in range(1, len(gram)):
        i = i[i + k < end[i]]
        i = i[size[i] * q >= size[i + k] * p]
        if not len(i):
            break
        if k > PARTNERS:
            some = np.zeros(len(gram), bool)
            some[i] = True
            passes |= np.repeat(np.logical_or.reduceat(some, cuts[:-1]), np.diff(cuts))
            break
        j = i + k
        if k == 1:
            fits[i] = fits[j] = True
        doubt = np.flatnonzero(~(passes[i] & passes[j]))
        x, y = i[doubt], j[doubt]
        ok = np.minimum(size[x] - pos[x], size[y] - pos[y]) * (p + q) >= p * (size[x] + size[y])
        x, y = x[ok], y[ok]
        if bits is not None and len(x):
            n = size[x] + size[y]
            ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= n - 2 * -(-p * n // (p + q))
            x, y = x[ok], y[ok]
        passes[x] = passes[y] = True
    return fits, passes


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Whole lists, from batches sorted by (gram, part); of lists longer than GATHERED rows, pieces, with True."""
    held, long = None, None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t, held = pa.concat_tables([held, t]), None
        key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("gram", "part")])
        at = 0
        if long is not None:
            other = np.flatnonzero((key != long[:, None]).any(0))
            at = int(other[0]) if len(other) else t.num_rows
            if at:
                yield t.slice(0, at), True
            if at == t.num_rows:
                continue
            long = None
        last = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
        last = max(last, at)
        if last > at:
            yield t.slice(at, last - at), False
        if t.num_rows - last > GATHERED:
            long = key[:, -1]
            yield t.slice(last), True
        else:
            held = t.slice(last)
    if held is not None:
        yield held, False


def _neighbours(threshold: Threshold):
    """For each entry of a sorted list, the closest by bitmap of those shortly before it in another component, NEIGHBOURS at most."""
    p, q = threshold.t.numerator, threshold.t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held_sig, held_size, held_root, held_bits = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BITMAP // 64), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            grams, sigs, sizes, roots = b.column("gram").to_numpy(), b.column("sig").to_pylist(), b.column("size").to_numpy().astype(np.int64), b.column("root").to_numpy()
            bits = b.column("bits").flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)
            found = set()
            cuts = [0, *(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if grams[i] != gram:
                    gram, held_sig, held_size, held_root, held_bits = grams[i], [], held_size[:0], held_root[:0], held_bits[:0]
                own_sig, own_size, own_root, own_bits = held_sig + sigs[i:j], np.concatenate([held_size, sizes[i:j]]), np.concatenate([held_root, roots[i:j]]), np.concatenate([held_bits, bits[i:j]])
                for k in range(len(held_sig), len(own_sig)):
                    lo = max(0, k - STRETCH)
                    if lo == k:
                        continue
                    n = own_size[lo:k] + own_size[k]
                    apart = np.bitwise_count(own_bits[lo:k] ^ own_bits[k]).sum(1, dtype=np.int64)
                    apart = np.where((apart <= n - 2 * -(-p * n // (p + q))) & (own_root[lo:k] != own_root[k]), apart, 1 << 30)
                    for m in np.argpartition(apart, NEIGHBOURS - 1)[:NEIGHBOURS] if len(apart) > NEIGHBOURS else range(len(apart)):
                        if apart[m] < 1 << 30:
                            x, y = own_sig[lo + m], own_sig[k]
                            found.add((min(x, y), max(x, y)))
                held_sig, held_size, held_root, held_bits = own_sig[-STRETCH:], own_size[-STRETCH:], own_root[-STRETCH:], own_bits[-STRETCH:]
            found = sorted(found)
            yield pa.record_batch([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

    return run


def suffix_apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> bool:
    """True if sorted sets surely differ in more than `most` elements: halves around a middle element differ at least by their sizes."""
    if abs(len(x) - len(y)) > most:
        return True
    if not depth or len(x) < 2 or len(y) < 2:
        return False
    w = y[len(y) // 2]
    i, j = int(np.searchsorted(x, w)), len(y) // 2
    left, right = abs(i - j), abs((len(x) - i) - (len(y) - j))
    if left + right > most:
        return True
    return suffix_apart(x[:i], y[:j], most - right, depth - 1) or suffix_apart(x[i:], y[j:], most - left, depth - 1)


def _verify(threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                need = threshold.overlap(len(x), len(y))
                if suffix_apart(x, y, len(x) + len(y) - 2 * need):
                    ok.append(False)
                    continue
                overlap = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(bool(threshold.links(overlap, len(x), len(y))))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, threshold: Fraction, fold: bool, id_col: str, text_col: str):
        self.spark, self.n, self.fold, self.threshold = docs.sparkSession, n, fold, Threshold(threshold)
        bounded_batches(self.spark)
        self.docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
        both = stored(self.docs.mapInArrow(trimmed(_describe(n, fold)), "doc_id long, size long, sig binary, bits array<bigint>, grams binary, counts binary"))
        self.described = both.where("size >= 0").select("doc_id", "size", "sig")
        total = self.described.agg(F.sum("size")).first()[0] or 0
        self.order = self.spark.sparkContext.broadcast(_frequent(both, total))
        # One node per set, numbered by its least document, or by its signature where an id has several texts.
        nodes = stored(both.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc"), F.min("bits").alias("bits"), F.min("size").alias("size")))
        self.repeated = nodes.groupBy("doc").count().where("count > 1").limit(1).count() > 0
        self.nodes = nodes.withColumn("node", F.xxhash64("sig") if self.repeated else F.col("doc"))

    def postings(self) -> DataFrame:
        """Entries of the lists of prefix n-grams that sets of fitting sizes have; near: another one passes the positional filter, too."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        found = self.docs.where("doc_id is not null").mapInArrow(trimmed(_prefixes(self.order, self.threshold, self.n, self.fold, LONGEST_LIST)), "gram long, part int, sig binary, size int, pos int, reach byte")
        threshold = self.threshold

        def shared(batches):
            last = None  # of a long list, the row before
            for t, long in _lists(batches):
                if not long:
                    gram = t.column("gram").to_numpy()
                    same = np.zeros(len(gram) + 1, bool)
                    same[1:-1] = gram[1:] == gram[:-1]
                    t = t.filter(pa.array(same[1:] | same[:-1] | (t.column("part").to_numpy() >= 0)))
                if not t.num_rows:
                    continue
                # Rows come sorted: a repeated (gram, sig) is a copy.
                gram, sig = t.column("gram").to_numpy(), t.column("sig").to_numpy()
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
                if long:
                    new[0] = last != (gram[0], sig[0])
                    last = gram[-1], sig[-1]
                t = t.filter(pa.array(new))
                fits, near = (np.ones(t.num_rows, bool),) * 2 if long else _with_partner(t, threshold)
                t = t.append_column("near", pa.array(near)).filter(pa.array(fits))
                yield from t.combine_chunks().to_batches()

        lists = found.repartition(parts, "gram", "part").sortWithinPartitions("gram", "part", "size", "sig").mapInArrow(shared, "gram long, part int, sig binary, size int, pos int, reach byte, near boolean")
        # An n-gram that no other prefix of a fitting size has is in no set that could be linked before a shared one: of those before it, only shared ones can be common.
        rank = F.row_number().over(Window.partitionBy("sig").orderBy("pos")) - 1
        p, q = self.threshold.t.numerator, self.threshold.t.denominator
        lists = lists.withColumn("rank", rank.cast("int"))
        # The n-grams that are the set's own are too many for any other set: the least overlap is with the shortest one.
        return lists.where(F.expr(f"size - (pos - rank) >= ceil({p} * size / {q}D - 1e-9)"))

    def close(self, lists: DataFrame) -> DataFrame:
        """Entries of the lists that have one whose bitmap does not rule it out."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        threshold = self.threshold

        def run(batches):
            for t, long in _lists(batches):
                if not long:
                    t = t.filter(pa.array(_with_partner(t, threshold)[1]))
                yield from t.drop_columns("bits").combine_chunks().to_batches()

        near = lists.where("near").drop("near").join(self.nodes.select("sig", "bits"), "sig").select("gram", "part", "sig", "size", "pos", "reach", "rank", "bits")
        return near.repartition(parts, "gram", "part").sortWithinPartitions("gram", "part", "size", "sig").mapInArrow(run, "gram long, part int, sig binary, size int, pos int, reach byte, rank int")

    def alike(self, bits_a: str, bits_b: str, a: str, b: str, words: int = BITMAP // 64) -> str:
        """SQL: the bitmaps do not rule the pair out; linked sets differ in at most a + b - 2 overlap n-grams."""
        p, q = self.threshold.t.numerator, self.threshold.t.denominator
        apart = " + ".join(f"bit_count({bits_a}[{k}] ^ {bits_b}[{k}])" for k in range(words))
        return f"({apart}) <= {a} + {b} - 2 * ceil({p} * ({a} + {b}) / {p + q}D - 1e-9)"

    def enough(self, k: str, reach: str, lacks: str, size: str, other_reach: str, other_size: str) -> str:
        """SQL: what the other set surely lacks of a set leaves enough for the least overlap."""
        p, q = self.threshold.t.numerator, self.threshold.t.denominator
        at = f"least({k}{reach}, {other_reach})"
        return f"({k}{size} - if({at} > 0, {k}{lacks}[{at} - 1], 0)) * {p + q} >= {p} * ({k}{size} + {other_size})"

    def links(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b: signatures) whose sets are linked, as nodes."""
        side = lambda k: known.select(F.col("sig").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("node", "bits", "size", "reach", "lacks")])
        enough = " and ".join(self.enough("", f"reach_{k}", f"lacks_{k}", f"size_{k}", f"reach_{m}", f"size_{m}") for k, m in ("ab", "ba"))
        full = pairs.join(side("a"), "a").join(side("b"), "b").where(F.expr(f"{enough} and {self.alike('bits_a', 'bits_b', 'size_a', 'size_b')}"))
        wanted = stored(full.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        ids = wanted.select(F.col("a").alias("doc_id")).union(wanted.select(F.col("b").alias("doc_id"))).distinct()
        if self.repeated:
            ids = known.join(ids, F.col("node") == ids["doc_id"], "left_semi").select(F.col("doc").alias("doc_id")).distinct()
        many = ids.count()
        if not many:
            return wanted
        # Texts are read again for these documents alone, and only with the set that named the node.
        chosen = self.docs.join(F.broadcast(ids) if many <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
        n, fold = self.n, self.fold

        def sets(batches):
            for b in batches:
                held = list(gram_sets(b.column("text"), n, fold))
                columns = [pa.array([f(s) for s in held], pa.binary()) for f in (signature, wide_parities, np.ndarray.tobytes)]
                yield pa.record_batch([b.column("doc_id"), *columns], ["doc_id", "sig", "bits", "grams"])

        own = known.select("sig", F.col("doc").alias("doc_id"), "node")
        found = chosen.mapInArrow(trimmed(sets), "doc_id long, sig binary, bits binary, grams binary").join(own, ["doc_id", "sig"]).dropDuplicates(["node"])
        found = stored(found.select("node", "bits", F.expr("octet_length(grams) div 8").alias("size"), "grams"))
        threshold = self.threshold

        def both(pairs: DataFrame, *columns: str) -> DataFrame:
            for k in ("a", "b"):
                pairs = pairs.join(found.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]), k)
            return pairs

        def alike(batches):
            for b in batches:
                n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
                apart = np.array([parity_distance(x, y) for x, y in zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)], np.int64)
                keep = pa.array(apart <= n + m - 2 * threshold.overlap(n, m))
                yield pa.record_batch([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

        likely = stored(both(wanted, "bits", "size").mapInArrow(alike, "a long, b long"))
        out = stored(both(likely, "grams").select("a", "b", F.col("grams_a").alias("set_a"), F.col("grams_b").alias("set_b")).mapInArrow(_verify(threshold), "a long, b long"))
        discard(wanted, found, likely)
        return out

    def rooted(self, df: DataFrame, roots: DataFrame | None) -> DataFrame:
        """`df` (sig) with the component of each set so far."""
        own = self.known.select("sig", "node")
        if roots is None:
            return df.join(own.select("sig", F.col("node").alias("root")), "sig")
        return df.join(own.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root")), "sig")

    @staticmethod
    def mixed(rooted: DataFrame, *key: str) -> DataFrame:
        """Entries of the lists that hold more than one component."""
        return rooted.join(rooted.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*key), list(key), "left_semi")

    def likely(self, lists: DataFrame, lacks: DataFrame) -> DataFrame:
        """Entries of the lists that a linked pair can share, with short: whether the set can be the shorter one there.

        All sets of a list reach the least place that one of them does, so what each has
        up to there and the others lack is known.  A shorter set must have enough left for one as
        long, and few enough n-grams before this one; the longer ones are bounded by it.
        """
        p, q = self.threshold.t.numerator, self.threshold.t.denominator
        each = lists.join(lacks.select("sig", "lacks"), "sig").join(lists.groupBy("gram").agg(F.min("reach").cast("int").alias("least")), "gram")
        short = F.expr(f"(size - greatest(pos, if(least > 0, lacks[least - 1], 0))) * {p + q} >= {2 * p} * size")
        each = each.select("gram", "part", "sig", "size", "pos", "rank", short.alias("short"))
        bounds = each.where("short").groupBy("gram").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("many"))
        kept = each.join(bounds, "gram").where(f"size >= low and size * {p} <= high * {q}")
        return kept.select("gram", "part", "sig", "size", "pos", "rank", "short")

    def round(self, entries: DataFrame, roots: DataFrame | None, number: int) -> DataFrame:
        """Links between neighbours in lists, across the components so far."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entries = self.rooted(entries.select("gram", "part", "sig", "size"), roots)
        if number:
            entries = self.mixed(entries, "gram", "part")
        # Sizes in bands, as those of linked sets are close; neighbours within a band change from round to round.
        band = F.expr(f"int(floor(log2(size) * 4 + {number % 2} / 2))") if number else F.col("size")
        entries = entries.join(self.known.select("sig", "bits"), "sig").withColumn("place", F.xxhash64("sig", F.lit(number))).withColumn("band", band)
        near = entries.repartition(parts, "gram", "part").sortWithinPartitions("gram", "part", "band", "place").select("gram", "part", "sig", "size", "root", "bits")
        return self.links(near.mapInArrow(_neighbours(self.threshold), "a binary, b binary").distinct(), self.known)

    def merged(self, roots: DataFrame | None, links: DataFrame) -> DataFrame:
        """(node, root) with more links; what held the roots and the links before is deleted."""
        if roots is None:
            out = components(links)
        elif not links.limit(1).count():
            out = roots
        else:
            out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
            discard(roots)
        discard(links)
        return out

    def lacks(self, lists: DataFrame) -> DataFrame:
        """(sig, reach, lacks): of each set, how many of PLACES its prefix reaches, and the n-grams up to each that no other prefix of a fitting size has.

        Its shared n-grams tell: as many as stand before one without being shared are lacked.
        """
        at, plain = F.shiftrightunsigned("gram", 32), F.col("part") == -1
        places = _places(self.threshold).tolist()
        counted = [F.coalesce(F.max(F.when(plain & (at < c), F.col("pos") - F.col("rank"))), F.lit(0)).alias(f"u{i}") for i, c in enumerate(places)]
        found = lists.groupBy("sig").agg(F.max("reach").cast("int").alias("reach"), *counted)
        return found.select("sig", "reach", F.array(*[f"u{i}" for i in range(len(places))]).alias("lacks"))

    def run(self) -> DataFrame:
        lists = stored(self.postings())
        close = stored(self.close(lists))
        # All that is known of the sets that may have links.
        self.known = stored(self.nodes.join(self.lacks(lists), "sig").join(close.select("sig").distinct(), "sig", "left_semi"))
        discard(lists)
        lacks = self.known.select("sig", "reach", "lacks")
        roots, number, many = None, 0, WORTH_A_ROUND
        entries = close.where(F.col("rank") < LISTS)
        while many >= WORTH_A_ROUND:
            found = self.round(entries, roots, number)
            many = found.count()
            roots = self.merged(roots, found)
            if not number:
                likely = stored(self.likely(close, lacks))
                discard(close)
                entries = likely.where(F.col("rank") < MORE_LISTS)
            number += 1
        # What is left: pairs in one list, but in different components.
        rest = self.mixed(self.rooted(likely, roots), "gram").join(self.known.select("sig", "reach", "lacks", "bits"), "sig")
        rest = stored(rest.select("gram", "sig", "root", "size", "pos", "short", "reach", "lacks", "bits"))
        p, q = self.threshold.t.numerator, self.threshold.t.denominator
        # The shorter is x; equal lengths by signature. It has a common n-gram among the first that it could lack with a set as long, and one more.
        x, y = rest.where("short").alias("x"), rest.alias("y")
        size = f"(x.size < y.size or (x.size = y.size and x.sig < y.sig)) and x.size * {q} >= y.size * {p}"
        # For the first common n-gram, all overlap is to come.
        place = f"least(x.size - x.pos, y.size - y.pos) * {p + q} >= {p} * (x.size + y.size)"
        enough = " and ".join(self.enough(f"{k}.", "reach", "lacks", "size", f"{m}.reach", f"{m}.size") for k, m in ("xy", "yx"))
        alike = self.alike("x.bits", "y.bits", "x.size", "y.size")
        pairs = x.join(y, F.expr(f"x.gram = y.gram and x.root <> y.root and {size} and {place} and {enough} and {alike}")).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
        last = self.links(pairs, self.known)
        final = self.merged(roots, last)
        discard(likely, self.known, rest)
        named = self.nodes.join(final, self.nodes["node"] == final["node"], "left").select("sig", "doc", F.coalesce("root", self.nodes["node"]).alias("component_id"))
        if self.repeated:  # the least document, as nodes are not numbered by theirs
            least = named.groupBy("component_id").agg(F.min("doc").alias("least"))
            named = named.join(least, "component_id").select("sig", F.col("least").alias("component_id"))
        named = named.select("sig", "component_id")
        return self.described.join(named, "sig", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, *, n: int = 5, threshold: Fraction = Fraction(8, 10), fold: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id reachable by links, its own included.

    Texts are null, empty or without words: no n-gram, linked with nothing.  Fewer than
    n words: one n-gram, the whole sequence.  Equal sets are linked.  Rows that repeat an
    id are documents of their own with that number; rows without an id link with nothing
    and have no component.  Ids are whole numbers; any other id is an error.  An empty
    table gives no row; other columns are left out, whatever their names.  A very long
    text is one set like any other, held in one task.
    """
    return _Join(docs, n, threshold, fold, id_col, text_col).run()
