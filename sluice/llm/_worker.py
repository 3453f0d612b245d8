"""What a Python worker keeps between tasks: the tables of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_HELD: list[tuple] = []


def held(key, make: Callable):
    """The value made for `key` in this worker; one made for another key is let go first, as workers outlive stages."""
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        gc.collect()
        _HELD.append((key, make()))
    return _HELD[0][1]


def release() -> None:
    """Let go of what another operator keeps, and give freed memory back: workers live on beside the next stage's."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def trimmed(run: Callable) -> Callable:
    """A function over batches that keeps nothing in its worker, before or after."""

    def go(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return go
