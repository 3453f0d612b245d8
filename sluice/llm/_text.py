"""Whole texts as byte buffers: vectorized word hashing over Arrow string columns.

A text column reaches Python as one byte buffer and an offset array.  The
helpers here work on those two arrays, a few hundred kilobytes at a time, so no
Python string is made and memory does not follow the size of a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once.
SEGMENT = 1 << 16

_U = np.uint64


def _separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = _separators(b" \t\n\x0b\x0c\r")
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Two lanes of constants: first value, multiplier and increment of a word's hash.
_LANES = tuple(tuple(_U(x) for x in lane) for lane in np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, (2, 3), np.uint64) | _U(1))
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; equal inputs have equal outputs."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_groups(offsets: np.ndarray, limit: int = SEGMENT):
    """Ranges (i, j) of documents with about `limit` bytes each; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Hashes of the words of some documents; `ptr[d]:ptr[d + 1]` are those of document d."""

    def __init__(self, h, start, end, ptr):
        self.h, self.start, self.end, self.ptr = h, start, end, ptr


def _hash_segment(data, first, last, fold, lane):
    """Hashes of words, eight bytes at a time: each is mixed into what came before, so no arithmetic relation between words survives."""
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    seed, odd, step = _LANES[lane]
    own = np.zeros(len(data) + 8, np.uint8)
    own[: len(data)] = fold[data] if fold is not None else data
    eight = np.ndarray((len(data) + 1,), "<u8", own, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    h = np.full(len(starts), seed, np.uint64) ^ (length.astype(np.uint64) * step)
    at, some = 0, np.flatnonzero(length <= LONG_WORD)
    while len(some):
        x = eight[starts[some] + at]
        left = np.minimum(length[some] - at, 8)
        x = x & (_U(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        h[some] = mix((h[some] ^ x) * odd + step)
        at += 8
        some = some[length[some] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(own[starts[i] : ends[i]].tobytes(), digest_size=16).digest()[8 * lane : 8 * lane + 8])
    return h, starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray | None = None, lane: int = 0) -> Words:
    """A 64-bit hash of every word, in order; equal words (after `fold`) have equal hashes anywhere.

    Words of up to eight bytes and of one length differ in it for certain.  The hashes of
    the two lanes are independent: together they name a word by 128 bits.

    Words never cross documents.  Long inputs are cut at separators, so a text of
    any length needs memory for one segment and for its own words.
    """
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    is_word = ~separators[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = is_word[begins]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | first[1:]
    hs, ss, es, at = [], [], [], 0
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n and is_word[to - 1] and not last[to - 1]:
            back = np.flatnonzero(last[at:to])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                while not last[to - 1]:
                    ahead = np.flatnonzero(last[to : to + SEGMENT])
                    to = to + int(ahead[0]) + 1 if len(ahead) else min(n, to + SEGMENT)
        h, s, e = _hash_segment(data[at:to], first[at:to], last[at:to], fold, lane)
        hs.append(h)
        ss.append(s + at)
        es.append(e + at)
        at = to
    starts = np.concatenate(ss)
    return Words(np.concatenate(hs), starts, np.concatenate(es), np.searchsorted(starts, offsets))


#: Multipliers that tell the places of a shingle apart.
_PLACE = [int(x) for x in np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 64) | 1]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one word sequence; with fewer words, of the whole sequence; empty if none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _U(_PLACE[i % 64]) + words[i : n - k + 1 + i])
    return out
