import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import _text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x1cé☃", max_size=40), max_size=8), st.sampled_from([4, 16, 1 << 16]))
def test_words_are_those_of_split(texts, segment):
    data, offsets = _text.text_buffer(pa.array(texts, pa.string()))
    old, _text.SEGMENT = _text.SEGMENT, segment
    try:
        w = _text.hash_words(data, offsets)
    finally:
        _text.SEGMENT = old
    seen = {}
    for d, t in enumerate(texts):
        words, hashes = t.encode().split(), w.h[w.ptr[d] : w.ptr[d + 1]].tolist()
        assert len(words) == len(hashes)
        for a, b in zip(words, hashes, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def thue_morse(n, other=False):
    """Strings that collide under any polynomial modulo a power of two."""
    s = "ab"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s.translate(str.maketrans("ab", "ba")) if other else s


@pytest.mark.parametrize("n", [8, 16, 64, 128, 1024, 2048, 4096])
def test_words_that_collide_under_polynomials(n):
    data, offsets = _text.text_buffer(pa.array([thue_morse(n), thue_morse(n, True), "x", thue_morse(n)]))
    for lane in (0, 1):
        h = _text.hash_words(data, offsets, lane=lane).h
        assert len(set(h.tolist())) == 3 and h[0] == h[3]
    assert set(h.tolist()).isdisjoint(_text.hash_words(data, offsets).h.tolist())


def test_buffers_of_slices_and_nulls():
    a = pa.array(["xx", None, "y z", "é"], pa.large_string())[1:]
    data, offsets = _text.text_buffer(a)
    assert bytes(data) == "y zé".encode() and offsets.tolist() == [0, 0, 3, 5]


@pytest.mark.parametrize("n, k, want", [(0, 3, 0), (2, 3, 1), (3, 3, 1), (5, 3, 3)])
def test_shingles(n, k, want):
    assert len(_text.shingle_hashes(np.arange(n, dtype=np.uint64), k)) == want
