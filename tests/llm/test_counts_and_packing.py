import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing, token_counts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", "don't  stop\n\n now ", "naïve — “q” 你好　a", "<|endoftext|> in <|startoftext|>x", "x" * 3000, "word " * 2500, "é" * 900, "a\x1cb \x85 c", " \t ", "1 23 456 ½²"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(2, "a", "again"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("chunk, overlap", [(65_536, 1024), (64, 8)])
def test_counts_are_the_librarys(docs, chunk, overlap):
    t = Tokenizer.from_file(WORD)
    got = token_counts.count_tokens(docs, WORD, limit=100, chunk_chars=chunk, overlap_chars=overlap).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(t.encode(r["text"] or "", add_special_tokens=False).ids), n > 100) for r in docs.collect())
    assert Counter(map(tuple, got)) == want


def test_a_tokenizer_that_joins_across_white_space(docs):
    assert token_counts.splits_at_space(WORD) and not token_counts.splits_at_space(BYTE)
    t = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(docs, BYTE).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_an_encoder_that_differs_is_given_up():
    e = packing.IdEncoder(BYTE)
    e.known["abc"] = b"\x01\x00\x00\x00"
    right = np.asarray(e.tokenizer.encode("abc", add_special_tokens=False).ids, "<u4").tobytes()
    assert e.encode(["abc"]) == [right] and not e.trusted and e.encode(["abc"]) == [right]


def test_an_unbroken_text_is_encoded_a_few_times():
    t, read = token_counts.load_tokenizer(WORD), []

    class Reader:
        def encode(self, text, **k):
            read.append(len(text))
            return t.encode(text, **k)

    text = "ab" * 20_000
    assert token_counts.spliced(Reader(), text, 512, 16)[0] == t.encode(text, add_special_tokens=False).ids
    assert sum(read) < 12 * len(text)


def test_counts_of_no_rows(docs):
    assert token_counts.count_tokens(docs.limit(0), WORD).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab' \n.é1", max_size=400), st.integers(8, 60), st.integers(1, 8))
def test_splices(text, chunk, overlap):
    t = token_counts.load_tokenizer(WORD)
    assert token_counts.spliced(t, text, chunk, overlap)[0] == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abzé'² \n\t.1½–好 ", max_size=80))
def test_ids_are_the_librarys(text):
    e = packing.IdEncoder(BYTE)
    assert e.merger is not None
    e.to_compare = 0  # the parts alone
    assert e.encode([text]) == [np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 12), max_size=20))
def test_plans_place_all(counts):
    plan, placed = packing.plan_packing(counts, 20), Counter()
    for lengths, copies in plan.patterns:
        assert sum(lengths) <= 20 and copies > 0
        for n in lengths:
            placed[n] += copies
    assert placed == Counter({n: c for n, c in counts.items() if c})
    rooms = []  # plain best-fit, longest first
    for n in sorted(placed.elements(), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 20) - n)
    assert sum(c for _, c in plan.patterns) <= len(rooms) * 1.1 + 1
    assert len(plan.patterns) <= 4 * len(placed)


def test_exact_complements():
    plan = packing.plan_packing({10: 3, 7: 2, 3: 2, 5: 1, 4: 1, 1: 1}, 10)
    assert sum(c for _, c in plan.patterns) == 6 and all(sum(x) == 10 for x, _ in plan.patterns)


def test_packing(docs):
    got = packing.pack_documents(docs, BYTE, capacity=16).collect()
    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 16 + 1
        cuts = [0, *range(first, len(ids), 16), len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 16
    assert packing.pack_documents(docs.limit(0), BYTE, capacity=16).collect() == []
