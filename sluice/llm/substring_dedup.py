"""Removal of long repeated word sequences by recompression.

A text is a string of word symbols.  The first round names the runs of one word;
each later round names pairs, a left symbol followed by a right one, where a coin
tossed on a symbol's name says which it is.  A name is a hash of what it stands
for, so every task gives equal strings equal names, without a dictionary to share.
A symbol's making depends only on the words in some reach around it, and the reach
is kept with it: wherever a stretch of words that holds the reach occurs, the same
symbol stands at the same place in it.

So a window of words that occurs twice has only symbols in it, of those whose reach
it holds, that occur twice.  One Spark round counts symbols over the corpus, each
chunk of documents telling each hash range which it has and hearing which of them
others have too.  Windows with a symbol that occurs once are out.  A second round
of the same form verifies the rest by 128 bits of their word sequences, from two
independent hashes of every word's bytes, both compared.
Chunks send a symbol or window twice at most, so one that is everywhere is no
burden, and nothing pairs up its places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._store import bounded_batches
from sluice.llm._text import doc_groups, hash_words, mix, text_buffer
from sluice.llm._worker import release

_U = np.uint64
#: Bytes of text in a chunk, about.
CHUNK = 1 << 23
#: Chunks up to which each has a task of its own; beyond, a task takes several in turn, with about so many bytes of text, as tasks exchange a block with each other one.
OWN_TASKS, TASK = 256, 1 << 26
#: Chunks to a hash range, of symbols and of windows: their values take less room than the texts.
SYMBOL_RANGE, WINDOW_RANGE = 4, 2
#: Rounds of pairs, and most words that a symbol spans.
ROUNDS, SPAN = 7, 16
_SALT = np.random.Generator(np.random.PCG64(4711)).integers(1, 2**64, 64, np.uint64) | _U(1)


def recompress(words: np.ndarray, ptr: np.ndarray, rounds: int = ROUNDS, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of the symbols of some documents after all rounds; low to high is the reach, in words.

    A reach that leaves its document is given as longer than any window.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    begin, end = ptr[:-1][doc], ptr[1:][doc]
    if not n:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Runs: a run of up to `span` words is one symbol; the words of a longer one stay, as they see no end of it within the reach.
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    start, stop = heads, np.append(heads[1:], n)
    length = stop - start
    at = np.arange(n)
    head = new | (length[run] > span)
    long = length[run] > span
    width = np.where(long, 1, length[run])
    low = np.where(long, np.maximum(start[run] - 1, at - span - 1), at - 1)
    high = np.where(long, np.minimum(stop[run] + 1, at + span + 2), at + width + 1)
    name = np.where(long | (width == 1), words, mix(words + width.astype(np.uint64) * _SALT[0]))
    outside = (low < begin) | (high > end)
    low, high = np.where(outside, -(1 << 40), low), np.where(outside, 1 << 40, high)
    name, low, high, width, doc = name[head], low[head], high[head], width[head], doc[head]
    for r in range(1, rounds + 1):
        m = len(name)
        if m < 2:
            break
        right = (mix(name + _SALT[r]) >> _U(63)).astype(bool)
        beside = doc[1:] == doc[:-1]
        pair = np.zeros(m, bool)
        pair[:-1] = beside & ~right[:-1] & right[1:] & (width[:-1] + width[1:] <= span)
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        # What stays depends on the neighbour that it might have joined; a pair on its two parts alone.
        new_low, new_high = low.copy(), high.copy()
        i = np.flatnonzero(beside & (~right[:-1]))
        new_low[i] = np.minimum(low[i], low[i + 1])
        new_high[i] = np.maximum(high[i], high[i + 1])
        j = np.flatnonzero(beside & right[1:] & ~pair[:-1]) + 1
        new_low[j] = np.minimum(low[j], low[j - 1])
        new_high[j] = np.maximum(high[j], high[j - 1])
        p = np.flatnonzero(pair)
        name = name.copy()
        name[p] = mix(name[p] * _SALT[20] + mix(name[p + 1] + _SALT[21]))
        width = width.copy()
        width[p] += width[p + 1]
        keep = ~second
        name, low, high, width, doc = name[keep], new_low[keep], new_high[keep], width[keep], doc[keep]
    return name, low, high


def window_hashes(lanes: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every `window` consecutive words, each from a lane of word hashes of its own."""
    n = len(lanes[0]) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out = []
    for k, words in zip((30, 40), lanes, strict=True):
        # by doubling: hashes of 1, 2, 4 ... words, joined to the window's length
        total, done, power = None, 0, mix(words + _SALT[k])
        size, rest = 1, window
        while rest:
            if rest & 1:
                own = power[done : done + n]
                total = own if total is None else mix(total * _SALT[k + 1] + own)
                done += size
            rest >>= 1
            if rest:
                power = mix(power[:-size] * _SALT[k + 2] + power[size:])
                size *= 2
        out.append(total)
    return out[0], out[1]


class _Group:
    """Words of some documents, and places of their windows."""

    def __init__(self, data, offsets, window):
        self.data, self.offsets = data, offsets
        self.w = hash_words(data, offsets)
        self.window = window
        n = len(self.w.h)
        self.fits = np.zeros(max(n - window + 1, 0), bool)  # windows within one document
        for a, b in zip(self.w.ptr[:-1], self.w.ptr[1:], strict=True):
            if b - a >= window:
                self.fits[a : b - window + 1] = True

    def windows(self):
        """128 bits of the bytes of every window."""
        return window_hashes((self.w.h, hash_words(self.data, self.offsets, lane=1).h), self.window)

    def symbols(self):
        name, low, high = recompress(self.w.h, self.w.ptr)
        ok = high - low <= self.window
        return name[ok], low[ok], high[ok]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Windows all of whose symbols occur twice."""
        name, low, high = self.symbols()
        once = ~_within(name, repeated)
        mark = np.zeros(len(self.w.h) + 2, np.int64)
        first = np.maximum(high[once] - self.window, 0)
        np.add.at(mark, first, 1)
        np.add.at(mark, low[once] + 1, -1)
        return np.flatnonzero(self.fits & (np.cumsum(mark)[: len(self.fits)] == 0))


def _within(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _groups(table: pa.Table, window: int) -> Iterator[_Group]:
    data, offsets = text_buffer(table.column("text"))
    for i, j in doc_groups(offsets):
        yield _Group(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)


def _twice(x: np.ndarray) -> np.ndarray:
    """Sorted, each value at most twice."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[2:] = x[2:] != x[:-2]
    return x[keep]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), [("a", np.uint64), ("b", np.uint64)])
    out["a"], out["b"] = a, b
    return out


def _pair_order(x: np.ndarray) -> np.ndarray:
    """Places of pairs in order, by the first halves alone where no two pairs differ in the second only."""
    a, b = np.ascontiguousarray(x["a"]), np.ascontiguousarray(x["b"])
    order = np.argsort(a)
    first, second = a[order], b[order]
    if ((first[1:] == first[:-1]) & (second[1:] != second[:-1])).any():
        return np.lexsort((b, a))
    return order


def _sorted_pairs(x: np.ndarray) -> np.ndarray:
    return x[_pair_order(x)]


def _new_pairs(x: np.ndarray, by: int) -> np.ndarray:
    """Of sorted pairs, whether each differs from the one `by` places before it."""
    new = np.ones(len(x), bool)
    new[by:] = (x["a"][by:] != x["a"][:-by]) | (x["b"][by:] != x["b"][:-by])
    return new


def _twice_pairs(x: np.ndarray) -> np.ndarray:
    x = _sorted_pairs(x)
    return x[_new_pairs(x, 2)]


def _within_pairs(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each pair is in a sorted table; both halves are compared."""
    found = np.zeros(len(x), bool)
    if not len(table) or not len(x):
        return found
    a, b = np.ascontiguousarray(table["a"]), np.ascontiguousarray(table["b"])
    at = np.searchsorted(a, x["a"])
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    for _ in range(int(np.diff(np.append(starts, len(a))).max())):  # once, unless first halves agree by chance
        i = np.minimum(at, len(a) - 1)
        found |= (a[i] == x["a"]) & (b[i] == x["b"])
        at = at + 1
    return found


def _cells(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary cells with the values between each two places of `cut`, made as one buffer."""
    at = np.asarray(cut, np.int64) * values.dtype.itemsize
    if len(at) and at[-1] >= 1 << 31:  # more than one array takes
        return pa.chunked_array([pa.array([values[i:j].tobytes()], pa.binary()) for i, j in zip(cut[:-1], cut[1:], strict=True)])
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _deal(chunk: int, first: np.ndarray, payload: np.ndarray, buckets: int) -> pa.Table:
    """Values sorted by their first word, cut into ranges of it."""
    # the bucket is the value's share of the 64-bit range
    bucket = ((first >> _U(32)).astype(np.int64) * buckets) >> 32
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    some = np.flatnonzero(cut[1:] > cut[:-1])
    return pa.table({"bucket": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), chunk, np.int32)), "payload": _cells(payload, np.append(cut[some], len(payload)))})


def _answer(kind: np.dtype):
    """For each chunk of a bucket, which of its values occur at least twice over all chunks.

    All chunks' values are worked on at once, as a chunk's share gets small where chunks are many.
    """

    def run(table: pa.Table) -> pa.Table:
        x, lengths = _values(table, kind)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = _pair_order(x) if kind.names else np.argsort(x)
        ranked = x[order]
        same = ~_new_pairs(ranked, 1)[1:] if kind.names else ranked[1:] == ranked[:-1]
        again = np.zeros(len(x), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        # each value of a chunk once; a chunk's values come sorted
        again[1:] &= (owner[1:] != owner[:-1]) | (_new_pairs(x, 1)[1:] if kind.names else x[1:] != x[:-1])
        kept = np.bincount(owner[again], minlength=len(lengths))
        some = np.flatnonzero(kept)
        cut = np.concatenate([[0], np.cumsum(kept[some])])
        return pa.table({"chunk": pa.array(table.column("chunk").to_numpy()[some], pa.int32()), "payload": _cells(x[again], cut)})

    return run


def _values(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values in all cells of a table, and how many each cell has."""
    data, offsets = text_buffer(table.column("payload"))
    return data.view(kind), np.diff(offsets) // kind.itemsize


_PAIR = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _heard(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return _values(table, kind)[0] if table.num_rows else np.zeros(0, kind)


def _sizes(total: int, least: int) -> tuple[int, int, int, int]:
    """How many chunks, tasks, and hash ranges of symbols and of windows, for so many bytes of text.

    A chunk is bounded, so chunks follow the text; tasks follow it much more slowly,
    as the blocks of a shuffle are as many as its tasks squared.
    """
    chunks = max(least, -(-total // CHUNK))
    tasks = max(least, min(chunks, max(OWN_TASKS, -(-total // TASK))))
    return chunks, tasks, max(least, -(-chunks // SYMBOL_RANGE)), max(least, -(-chunks // WINDOW_RANGE))


def remove_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """The columns `keep` (the id, by default), n_words, n_removed, kept_sha256 of every row, and kept_text if asked for.

    Words are runs of bytes other than space and \\t to \\r.  Each word in a sequence of
    `window` words that also starts elsewhere, in the same document or another, is
    removed; what is left is joined by single spaces.  All is judged on the input, so
    every copy of a repeated passage goes.  Null and empty texts have no words; texts
    shorter than a window stay.  Rows that repeat an id, and rows without one, are
    documents like any other.  A very long text is read a few words at a time, in one
    task.  An empty table gives no row.  Other columns may have any names; those of
    `keep` that are called like the columns added are given beside them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [id_col] if keep is None else keep
    # Chunks and hash ranges are as many as the text asks for, so what a task holds does not grow with the corpus.
    # A chunk tells a range at most once, and not without a value in it: no more rows than distinct values.
    # A task goes through several of them where they are many.
    total = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    chunks, parts, symbol_ranges, window_ranges = _sizes(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [(F.lit(None).cast(docs.schema[c].dataType) if c == text_col else docs[c]).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("text", *[f"k{i}" for i in range(len(keep))]), F.lit(chunks)).cast("int"))
    # The one shuffle of texts; all three readers below share it.
    rows = rows.repartition(parts, "chunk")

    def tell_symbols(t: pa.Table) -> pa.Table:
        release()
        found = [_twice(g.symbols()[0]) for g in _groups(t, window)]
        x = _twice(np.concatenate([*found, np.zeros(0, np.uint64)]))
        return _deal(t.column("chunk")[0].as_py(), x, x, symbol_ranges)

    def tell_windows(t: pa.Table, heard: pa.Table) -> pa.Table:
        repeated = np.sort(_heard(heard, np.dtype(np.uint64)))
        found = [np.zeros(0, _PAIR)]
        for g in _groups(t, window):
            at = g.candidates(repeated)
            if len(at):
                a, b = g.windows()
                found.append(_pairs(a[at], b[at]))
        x = _twice_pairs(np.concatenate(found))
        chunk = t.column("chunk")[0].as_py() if t.num_rows else 0
        return _deal(chunk, x["a"], x, window_ranges)

    def cut(t: pa.Table, heard: pa.Table) -> pa.Table:
        repeated = _sorted_pairs(_heard(heard, _PAIR))
        texts = t.column("text")
        data, offsets = text_buffer(texts)
        n_words, n_removed, shas, left = [], [], [], []
        for i, j in doc_groups(offsets):
            own = data[offsets[i] : offsets[j]]
            g = _Group(own, offsets[i : j + 1] - offsets[i], window)
            gone = np.zeros(len(g.w.h) + 1, np.int64)
            if len(repeated) and g.fits.any():
                a, b = g.windows()
                hit = np.flatnonzero(g.fits & _within_pairs(_pairs(a, b), repeated))
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            raw = own.tobytes()
            for d in range(j - i):
                p, q = g.w.ptr[d], g.w.ptr[d + 1]
                lost = gone[p:q]
                removed = int(lost.sum())
                if removed:
                    stay = np.flatnonzero(~lost) + p
                    out = b" ".join([raw[s:e] for s, e in zip(g.w.start[stay].tolist(), g.w.end[stay].tolist(), strict=True)])
                else:
                    out = b" ".join(raw[offsets[i + d] - offsets[i] : offsets[i + d + 1] - offsets[i]].split())
                n_words.append(int(q - p))
                n_removed.append(removed)
                shas.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    left.append(out.decode() if texts[i + d].is_valid else None)
        columns = [texts if c == text_col else t.column(f"k{k}") for k, c in enumerate(keep)] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
        names = [f"k{k}" for k in range(len(keep))] + ["n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(left, pa.string()))
            names.append("kept_text")
        out = pa.table(columns, names)
        release()
        return out

    dealt, told = "bucket int, chunk int, payload binary", "chunk int, payload binary"
    by_chunk = rows.groupBy("chunk")
    symbols = by_chunk.applyInArrow(tell_symbols, dealt).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_answer(np.dtype(np.uint64)), told)
    windows = by_chunk.cogroup(symbols.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(tell_windows, dealt)
    windows = windows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_answer(_PAIR), told)
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = f"{fields}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = by_chunk.cogroup(windows.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(cut, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[len(keep) :])
