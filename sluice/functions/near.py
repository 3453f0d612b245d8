"""Pairs of 64-bit fingerprints that differ in few bits, exactly, within two tables of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np

#: Blocks that the bits are dealt to.  Two of them, at least, are equal where no more than four bits differ.
BLOCKS = 6
#: Pairs compared at once.
AT_ONCE = 1 << 20
_BITS = np.arange(64, dtype=np.uint64)


def layout(hashes: np.ndarray) -> list[np.uint64]:
    """Masks of the blocks.  Any layout finds all pairs; bits are dealt so that all blocks tell these hashes apart about as well."""
    ones = np.array([np.count_nonzero(hashes >> b & np.uint64(1)) for b in _BITS]) / max(1, len(hashes))
    with np.errstate(divide="ignore", invalid="ignore"):
        tells = -np.nan_to_num(ones * np.log2(ones) + (1 - ones) * np.log2(1 - ones))
    masks, told = [np.uint64(0)] * BLOCKS, [0.0] * BLOCKS
    for b in np.argsort(-tells, kind="stable"):
        i = min(range(BLOCKS), key=lambda i: (told[i], int(masks[i]).bit_count()))
        masks[i], told[i] = masks[i] | np.uint64(1) << np.uint64(b), told[i] + tells[b]
    return masks


def _within(x: np.ndarray, y: np.ndarray, mask: np.uint64, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs within `most` bits that are equal under the mask, some at a time."""
    by_x, by_y = np.argsort(x & mask), np.argsort(y & mask)
    xs, ys = x[by_x], y[by_y]
    keys = ys & mask
    low, high = (np.searchsorted(keys, xs & mask, side) for side in ("left", "right"))
    n = high - low
    until, i = np.cumsum(n), 0
    while i < len(xs):
        done = until[i] - n[i]
        j = max(i + 1, int(np.searchsorted(until, done + AT_ONCE, "right")))
        if until[j - 1] > done:
            own = np.repeat(np.arange(i, j), n[i:j])
            other = np.arange(done, until[j - 1]) + (low[i:j] - (until[i:j] - n[i:j])).repeat(n[i:j])
            near = np.flatnonzero(np.bitwise_count(xs[own] ^ ys[other]) <= most)
            if len(near):
                yield by_x[own[near]], by_y[other[near]]
        i = j


def covered(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether each of `x` is within `most` (4, or fewer) bits of one of `y`; what is found is not looked at again."""
    found, left = np.zeros(len(x), bool), np.arange(len(x))
    for two in combinations(layout(y), 2):
        for i, _ in _within(x[left], y, two[0] | two[1], most):
            found[left[i]] = True
        left = left[~found[left]]
    return found


def pairs(x: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of `x` and `y` within `most` (4, or fewer) bits, each once, some at a time."""
    before: list[np.uint64] = []
    for two in combinations(layout(y), 2):
        mask = two[0] | two[1]
        for i, j in _within(x, y, mask, most):
            differ = x[i] ^ y[j]
            new = np.ones(len(i), bool)
            for m in before:
                new &= (differ & m) != 0
            if new.any():
                yield i[new], j[new]
        before.append(mask)
