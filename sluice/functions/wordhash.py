"""Hashes of the words of whole texts, from byte buffers, in Arrow batches: no row per word and no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is alone.
STRETCH = 1 << 18
_START, _PRIME, _MASK = np.uint64(2166136261), np.uint64(16777619), np.uint64(0xFFFFFFFF)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True


def stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) of some texts at a time; null counts as empty."""
    column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRETCH, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every run of a-z and 0-9; runs end with their text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1]
    first[begins] = inside[begins]
    start = np.flatnonzero(first[:-1])
    stop = inside[:-1].copy()
    stop &= ~inside[1:] | first[1:]
    cut = offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= len(data))] - 1
    stop[cut] = inside[cut]
    return start, np.flatnonzero(stop) + 1, np.searchsorted(offsets, start, "right") - 1


def fnv1a32(data: np.ndarray, start: np.ndarray, end: np.ndarray, backwards: bool = False, seed: np.uint64 = _START) -> np.ndarray:
    """FNV-1a, 32 bits, of every span of bytes: one step of all spans at a time."""
    h, length = np.full(len(start), seed, np.uint64), end - start
    some, k = np.flatnonzero(length > 0), 0
    while len(some):
        at = end[some] - 1 - k if backwards else start[some] + k
        h[some] = ((h[some] ^ data[at]) * _PRIME) & _MASK
        k += 1
        some = some[length[some] > k]
    return h


def simhashes(column: pa.Array) -> np.ndarray:
    """64 signed-bit votes of the words of every text, each hashed forwards and backwards; 0 without words."""
    out = np.zeros(len(column), np.uint64)
    for i, j, data, offsets in stretches(column):
        start, end, text = words(data, offsets)
        for a in range(0, len(start), 1 << 15):  # bits are spread to bytes, so only so many words at once
            b = min(len(start), a + (1 << 15))
            h = (fnv1a32(data, start[a:b], end[a:b]) << np.uint64(32)) | fnv1a32(data, start[a:b], end[a:b], backwards=True)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own, heads = np.unique(text[a:b], return_index=True)
            ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
            sums = 2 * ones - np.diff(np.append(heads, b - a))[:, None]
            if a == 0:
                total = np.zeros((j - i, 64), np.int64)
            total[own] += sums
        if len(start):
            out[i:j] = np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def term_vectors(column: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, index, value) of the signed hashed terms: words, pairs of neighbours, and three and four letters of each bordered word."""
    for i, _, data, offsets in stretches(column):
        start, end, text = words(data, offsets)
        if not len(start):
            continue
        length = end - start
        # Words with one blank after each, so a pair is a span; and words between their borders.
        at = np.concatenate([[0], np.cumsum(length + 1)])
        inner = np.repeat(np.arange(len(start)), length)
        source = data[start[inner] + np.arange(len(inner)) - np.repeat(np.cumsum(length) - length, length)]
        spaced = np.full(at[-1], 32, np.uint8)
        spaced[np.arange(len(inner)) + inner] = source
        low, high = at[:-1], at[1:] - 1
        hashes, texts = [fnv1a32(spaced, low, high)], [text]
        pair = np.flatnonzero(text[1:] == text[:-1])
        hashes.append(fnv1a32(spaced, low[pair], high[pair + 1]))
        texts.append(text[pair])
        edge = np.concatenate([[0], np.cumsum(length + 2)])
        bordered = np.full(edge[-1], ord("^"), np.uint8)
        bordered[edge[1:] - 1] = ord("$")
        bordered[np.arange(len(inner)) + 2 * inner + 1] = source
        word = np.repeat(np.arange(len(start)), length + 2)
        for k in (3, 4):
            first = np.flatnonzero(np.arange(len(bordered)) + k <= edge[word + 1])
            hashes.append(fnv1a32(bordered, first, first + k, seed=((_START ^ np.uint64(ord("#"))) * _PRIME) & _MASK))
            texts.append(text[word[first]])
        h, t = np.concatenate(hashes), np.concatenate(texts)
        sign = np.where((h >> np.uint64(31)).astype(bool), -1.0, 1.0)
        key, inverse = np.unique(t * dims + (h & np.uint64(dims - 1)).astype(np.int64), return_inverse=True)
        x = np.bincount(inverse, sign)
        norm = np.sqrt(np.bincount(key // dims, x * x))[key // dims]
        some = norm > 0
        yield i + key[some] // dims, key[some] % dims, x[some] / norm[some]
