"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents are tokenized once; only those longer than a sequence are cut.  The
planner sees nothing but the number of pieces of each length, at most one entry
per length, whatever the size of the corpus.  It indexes the lengths and the sums of
two and of three, and looks up, for the gap that each length leaves, one, two or three
pieces that fill it exactly; they are consumed as often as the counts allow.  What is
left then goes by best fit, with the same look-ups for what is left of a gap.  The plan says which ranks of each
length go where; a piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._store import bounded_batches, stored
from sluice.llm._worker import held
from sluice.llm.token_counts import load_tokenizer

#: In texts of these characters alone, the tokenizer's split into letters, numbers and the rest is the pattern below.
_OUTSIDE = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\r"
_SPLIT = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
CACHE, LONGEST = 150_000, 48
#: First texts of an encoder that are encoded both ways.
COMPARED = 64


def _merger(path: str):
    """A merge engine without the splitting and offsets of the tokenizer file's own library, for single parts.

    Only where the file's ids are in the order of its merges, as then both merge alike
    (lowest id first); otherwise None.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model.get("vocab"), model.get("merges")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges or []]
    if model.get("type") not in (None, "BPE") or not pairs or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as they are; the rest follow from 256 on
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
    if len(ranks) != 256 + len(pairs):
        return None
    import tiktoken

    return tiktoken.Encoding("parts", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class IdEncoder:
    """Little-endian 32-bit ids of texts.

    The byte-level BPE merges nothing across the parts of its split pattern, so a
    part is encoded once and its ids remembered.  Texts with other characters or
    with an added token's string go to the tokenizer whole.  Every encoder begins by
    comparing: parts made of the vocabulary, and its first texts, are encoded by the
    tokenizer as well, and where one differs, all go to the tokenizer from then on.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = load_tokenizer(path), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = _merger(path)
        self.trusted, self.to_compare = True, COMPARED
        tokens = sorted(self.tokenizer.get_vocab())[:: max(1, self.tokenizer.get_vocab_size() // 500)]
        probes = [p for a, b in zip(tokens, tokens[1:], strict=False) for p in _SPLIT.findall(f"{a}{b}{a.lower()}") if not _OUTSIDE.search(p)]
        if self.merger is not None and self._parts(probes) != self._raw(probes):
            self.merger = None

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of single parts of the split."""
        if self.merger is None:
            return self._raw(parts)
        merge = self.merger._encode_single_piece
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(merge, parts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.trusted:
            return self._raw(texts)
        out = self._by_parts(texts)
        if self.to_compare:
            first = self._raw(texts[: self.to_compare])
            self.to_compare -= len(first)
            if first != out[: len(first)]:
                self.trusted = False
                return self._raw(texts)
        return out

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        get, waiting, missing, whole = self.known.get, [], set(), []
        for i, text in enumerate(texts):
            if _OUTSIDE.search(text) or any(s in text for s in self.special):
                whole.append(i)
                continue
            parts = _SPLIT.findall(text)
            found = list(map(get, parts))
            if None in found:
                missing.update(p for p, x in zip(parts, found, strict=True) if x is None)
                waiting.append((i, parts, found))
            else:
                out[i] = b"".join(found)
        if waiting:
            parts = list(missing)
            new = dict(zip(parts, self._parts(parts), strict=True))
            for i, parts, found in waiting:
                out[i] = b"".join([x if x is not None else new[p] for p, x in zip(parts, found, strict=True)])
            if len(self.known) < CACHE:
                self.known.update((p, x) for p, x in new.items() if len(p) <= LONGEST)
        for i in whole:
            out[i] = self._raw([texts[i]])[0]
        return out


def _pieces(path: str, capacity: int, end_id: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("ids", path), lambda: IdEncoder(path))
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column(id_col).slice(at, 256)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, x in enumerate(encoder.encode([t or "" for t in batch.column(text_col).slice(at, 256).to_pylist()])):
                    x += end
                    n = len(x) // 4
                    first = (n - 1) % capacity + 1
                    for k, a in enumerate([0, *range(first, n, capacity)]):
                        b = first if k == 0 else a + capacity
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(x[4 * a : 4 * b]))
                yield pa.record_batch([ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut only where they exceed a sequence."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(_pieces(tokenizer_path, capacity, end_id, id_col, text_col), schema)


class Plan:
    """(lengths, copies) of all patterns of sequences, in order."""

    def __init__(self):
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def add(self, lengths: tuple[int, ...], copies: int) -> None:
        self.patterns.append((lengths, copies))

    def slots(self) -> dict[str, np.ndarray]:
        """Sorted by (length, rank): from `rank` on, pieces go to sequence `base` + rank - `rank`, at `offset`."""
        used: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for lengths, copies in self.patterns:
            offset = 0
            for n in lengths:
                rows.append((n, used[n], base, offset))
                used[n] += copies
                offset += n
            base += copies
        rows.sort()
        table = np.asarray(rows, np.int64).reshape(-1, 4)
        return {"length": table[:, 0], "rank": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


class _Lengths:
    """Available pieces by length, with bit indexes of the lengths and of the sums of two and of three."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.limit = (1 << (capacity + 1)) - 1
        self._index()

    def _index(self) -> None:
        self.singles = sum(1 << n for n in self.left)
        self.pairs = 0
        for n in self.left:
            self.pairs |= (self.singles << n) & self.limit
        self.triples = 0
        for n in self.left:
            self.triples |= (self.pairs << n) & self.limit

    def longest(self, limit: int) -> int:
        """The greatest length up to `limit`, 0 if there is none."""
        return (self.singles & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.singles & ((1 << (limit + 1)) - 1) else 0

    def has(self, items: list[int]) -> bool:
        return all(self.left.get(n, 0) >= items.count(n) for n in set(items))

    def take(self, items: list[int]) -> int:
        """Use up as many such sequences as the counts allow."""
        copies = min(self.left[n] // items.count(n) for n in set(items))
        for n in set(items):
            self.left[n] -= copies * items.count(n)
        if any(not self.left[n] for n in set(items)):
            self.left = {n: c for n, c in self.left.items() if c}
            self._index()
        return copies

    def exact(self, used: list[int], gap: int) -> list[int] | None:
        """One, two or three pieces that fill `gap` to the token beside those used, the longest first."""
        if self.has([*used, gap]):
            return [gap]
        if self.pairs >> gap & 1:
            a = self.longest(gap - 1)
            while 2 * a >= gap:
                if self.has([*used, a, gap - a]):
                    return [a, gap - a]
                a = self.longest(a - 1)
        if not self.triples >> gap & 1:
            return None
        a = self.longest(gap - 2)
        while a and 3 * a >= gap:
            if self.pairs >> (gap - a) & 1:
                b = self.longest(min(a, gap - a - 1))
                while b and 2 * b >= gap - a:
                    if self.has([*used, a, b, gap - a - b]):
                        return [a, b, gap - a - b]
                    b = self.longest(b - 1)
            a = self.longest(a - 1)
        return None


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Places for `counts[n]` pieces of each length n, 1 <= n <= capacity.

    First the lengths, the longest first, open sequences whose gap is the length, or the
    sum of two or three lengths, of available pieces.  When none is left, the longest
    piece opens a sequence, the longest that fits goes in, and what is then left of the
    gap is looked up again.  A pattern is used as often as the counts allow, so every step
    uses up a length or leaves fewer of it than a sequence would hold: the plan has a few
    entries per length, however many pieces there are.
    """
    lengths, plan = _Lengths(counts, capacity), Plan()
    for n in sorted(lengths.left, reverse=True):
        while lengths.left.get(n):
            found = lengths.exact([n], capacity - n) if n < capacity else []
            if found is None:
                break
            plan.add((n, *found), lengths.take([n, *found]))
    while lengths.left:
        items = [max(lengths.left)]
        gap = capacity - items[0]
        while gap:
            found = lengths.exact(items, gap)
            if found:
                items += found
                break
            best = lengths.longest(gap)
            while best and lengths.left[best] <= items.count(best):
                best = lengths.longest(best - 1)
            if not best:
                break
            items.append(best)
            gap -= best
        plan.add(tuple(items), lengths.take(items))
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` with sequence_id and offset.

    `pieces` needs doc_id, piece, start, length and ids_crc32 and must give the same
    rows whenever it is read (a table or a checkpoint).  Ranks are counted within a
    length and a hash bucket of it, so no length, however frequent, meets in one task.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["length", "bucket"]
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(4 * parts)).cast("int"))
    sizes = keyed.groupBy(*key).count()
    # One row per length and bucket, so the running sums over a length have 4 * parts rows at most.
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*key, F.coalesce("before", F.lit(0)).alias("before"))
    # At most `capacity` rows.
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan_packing(counts, capacity).slots())
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(before, key).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        # Within a length, slots are sorted by first rank: one search over (length, rank) finds a piece's slot.
        first = np.searchsorted(s["length"], np.arange(capacity + 2))
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            slot = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                slot[own] = first[n] + np.searchsorted(s["rank"][first[n] : first[n + 1]], rank[own], "right") - 1
            yield pa.record_batch([*b.columns[:5], pa.array(s["base"][slot] + rank - s["rank"][slot]), pa.array(s["offset"][slot])], [*b.schema.names[:5], "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(place, f"doc_id {kinds['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts are the end id alone.  Rows with a null id, and repeated rows,
    are packed like any other; other columns are left out, whatever their names.  An
    empty table gives no row.  A very long text is many pieces.  Which of several pieces of
    one length comes first is by bucket, then id; ties are equal pieces.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    return pack(stored(pieces), capacity)
