import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import _graph, fingerprints, ngram_join, substring_dedup
from test_text import thue_morse


def words_of(t):
    return (t or "").encode().split()


def grams(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, p, q):
    sets, up = [grams(t, n) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            o = len(sets[i] & sets[j])
            if q * o >= p * (len(sets[i]) + len(sets[j]) - o):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 8, 40, 120])))) for i in range(30)]
    for i in range(30, 110):  # copies with a few changes: near and not quite near
        w = rng.choice(rows[:30])[1].split()
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    hot = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(110, 190):  # a group that is partly near
        w = list(hot)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "UPPER lower É"), (204, "upper LOWER É"), (205, "upper lower é"), (None, hot[0]), (None, " ".join(hot)), (3, rows[3][1]), (206, "a b " * 3000), (207, "a b " * 3000)]
    return rows


@pytest.mark.parametrize("n, t, longest", [(3, Fraction(9, 10), 1024), (3, Fraction(9, 10), 4), (5, Fraction(8, 10), 4), (1, Fraction(1, 2), 1024)])
def test_components_are_those_of_all_links(spark, monkeypatch, n, t, longest):
    monkeypatch.setattr(ngram_join, "LONGEST_LIST", longest)
    rows = corpus(n)
    df = spark.createDataFrame([(d, x, 0) for d, x in rows], "doc_id long, text string, component_id int")
    got = Counter(map(tuple, ngram_join.jaccard_components(df, n=n, threshold=t).collect()))
    assert got == components(rows, n, t.numerator, t.denominator)


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(6)
    rows = []
    for i in range(6):  # an id with three texts, each with a near copy before or after it
        for k in range(3):
            w = [f"w{rng.randrange(500)}" for _ in range(100)]
            rows += [(100 + i, " ".join(w)), (10 * i + k if k < 2 else 200 + i, " ".join(w + ["end"]))]
    got = Counter(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, threshold=Fraction(9, 10)).collect()))
    assert got == components(rows, 3, 9, 10)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_collide_under_polynomials(spark, n):
    x, y = thue_morse(n), thue_morse(n, True)
    rest = [f"w{i}" for i in range(40)]
    one = " ".join(w for i in range(38) for w in (x, rest[i]))
    docs = spark.createDataFrame([(1, one), (2, one.replace(x, y))], "doc_id long, text string")
    assert sorted(r["component_id"] for r in ngram_join.jaccard_components(docs, n=3).collect()) == [1, 2]
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(docs, window=35).collect()] == [0, 0]
    assert len({r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}) == 2


def test_groups_of_alike_texts(spark, monkeypatch):
    """Thousands of texts alike below the threshold: the pairs that are verified grow with the texts, not their square."""
    asked, links = [], ngram_join._Join.links
    monkeypatch.setattr(ngram_join._Join, "links", lambda self, pairs, lacks: (asked.append(pairs.count()), links(self, pairs, lacks))[1])
    monkeypatch.setattr(ngram_join, "WORTH_A_ROUND", 10)
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        w = [f"b{k}" for k in range(300)]
        for _ in range(6 if i < 1200 else 3):  # two of the first are 0.7 alike, two of the others 0.82
            w[rng.randrange(300)] = f"n{i} {rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"d{i}x{k}" for k in range(3000)) + " " + " ".join(f"p{k}" for k in range(60))) for i in range(300)]  # long texts that share a passage
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), n=5).collect()
    assert sum(asked) < 3 * len(rows)
    sets = [grams(t, 5) for _, t in rows[1180:1260]]
    at = {r["doc_id"]: r["component_id"] for r in got}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 10 * len(x & y) >= 8 * len(x | y):
                assert at[1180 + i] == at[1180 + j]
    assert all(at[d] == d for d in range(2000, 2300)) and len({at[d] for d in range(1200, 1500)}) < 30


def test_chance_meetings_end_in_their_lists(spark, monkeypatch):
    """Texts that share a few rare n-grams and nothing else are no entries of the steps after the lists."""
    entries, likely = [], ngram_join._Join.likely
    monkeypatch.setattr(ngram_join._Join, "likely", lambda self, lists, lacks: (entries.append(lists.count()), likely(self, lists, lacks))[1])
    rng = random.Random(8)
    rows = [(i, [f"w{i}x{k}" for k in range(150)]) for i in range(400)]
    for i, w in rows:
        for j in rng.sample(range(400), 4):
            at = rng.randrange(140)
            w[at : at + 6] = [f"w{j}x{k}" for k in range(at, at + 6)]
    rows += [(1000 + i, [*rows[i][1], "end"]) for i in range(10)]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = Counter(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, threshold=Fraction(9, 10)).collect()))
    assert got == components(rows, 3, 9, 10)
    assert 0 < entries[0] <= 2 * 10 * 17  # the prefixes of the linked ones


@pytest.mark.parametrize("partners", [64, 2])
def test_partners_in_lists(monkeypatch, partners):
    monkeypatch.setattr(ngram_join, "PARTNERS", partners)
    monkeypatch.setattr(ngram_join, "GATHERED", 40)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(200):
        for _ in range(70 if g == 90 else rng.integers(1, 12)):
            size = int(rng.integers(20, 60))
            rows.append((g, 0 if g % 50 == 49 else -1, size, int(rng.integers(0, size // 10 + 1)), rng.integers(-(2**63), 2**63, 16).tolist()))
            if rng.random() < 0.3:  # the same bitmap, but for little
                rows.append((g, rows[-1][1], size, rows[-1][3], [rows[-1][4][0] ^ 1, *rows[-1][4][1:]]))
    rows.sort(key=lambda r: r[:3])
    t = pa.table({c: pa.array([r[k] for r in rows], y) for k, (c, y) in enumerate([("gram", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("pos", pa.int32()), ("bits", pa.list_(pa.int64()))])})
    pieces = list(ngram_join._lists(iter(t.to_batches(max_chunksize=13))))
    assert pa.concat_tables([x for x, _ in pieces]).equals(t.combine_chunks()) or pa.concat_tables([x for x, _ in pieces]).to_pylist() == t.to_pylist()
    assert {g for x, long in pieces if long for g in x.column("gram").to_pylist()} == {90}
    whole = [set(x.column("gram").to_pylist()) for x, long in pieces if not long]
    assert sum(map(len, whole)) == len(set().union(*whole)) == 199
    t = t.filter(pa.array([r[0] != 90 for r in rows]))
    rows = t.to_pylist()
    for table, alike in ((t, True), (t.drop_columns("bits"), False)):
        fits, passes = ngram_join._with_partner(table, ngram_join.Threshold(Fraction(9, 10)))
        for i, x in enumerate(rows):
            others = [y for j, y in enumerate(rows) if j != i and y["gram"] == x["gram"] and 10 * min(x["size"], y["size"]) >= 9 * max(x["size"], y["size"])]
            assert fits[i] == (x["part"] >= 0 or bool(others))
            good = False
            for y in others:
                n = x["size"] + y["size"]
                apart = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x["bits"], y["bits"], strict=True))
                good |= 19 * min(x["size"] - x["pos"], y["size"] - y["pos"]) >= 9 * n and (not alike or apart <= n - 2 * -(-9 * n // 19))
            assert passes[i] == (x["part"] >= 0 or good) if partners == 64 else passes[i] >= good


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(df).collect() == []
    assert substring_dedup.remove_repeats(df).collect() == []


def test_graph(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    got = {r["node"]: r["root"] for r in _graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    for x in {x for e in edges for x in e}:
        assert got.get(x, x) == root(x)


def repeats(rows, window):
    words = [words_of(t) for _, t in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = Counter()
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[(d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_go(spark, seed):
    rng = random.Random(seed)
    some = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    passage, short = some(50, 500), some(34, 500)
    rows = []
    for i in range(40):
        parts = some(rng.randrange(60), 500)
        if i % 3 == 0:
            parts += passage[rng.randrange(10) :]
        if i % 4 == 0:
            parts += short
        if i % 5 == 0:
            parts += ["a", "b"] * rng.randrange(30)
        if i % 7 == 0:
            parts += ["x"] * rng.randrange(90)
        rows.append((i, " \n".join(parts + some(rng.randrange(20), 500))))
    rows += [(50, None), (51, ""), (52, "a " * 100), (53, "a " * 35), (54, "c " * 34), (55, "d " * 35), (56, "e " * 36), (None, rows[0][1]), (7, rows[7][1]), (60, "é\x1cf " * 40), (61, " ".join(some(20_000, 7)))]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    got = Counter(map(tuple, substring_dedup.remove_repeats(df, window=35).collect()))
    assert got == repeats(rows, 35)


def test_many_chunks_share_tasks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 2000)
    monkeypatch.setattr(substring_dedup, "OWN_TASKS", 3, raising=False)
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passages = [some(45) for _ in range(8)]
    rows = [(i, " ".join(some(20) + passages[rng.randrange(8)][rng.randrange(11) :] + some(20))) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=35)
        assert Counter(map(tuple, out.collect())) == repeats(rows, 35)
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # 150 KB are 70 chunks and more; with a task for each, a shuffle would have as many blocks as their square
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)]
    assert dealt and max(dealt) <= 3


@pytest.mark.parametrize("kind", [np.dtype(np.uint64), substring_dedup._PAIR])
def test_answers_are_values_of_two_places(kind):
    rng = np.random.default_rng(5)
    parts = [np.sort(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    if kind.names:  # second halves tell pairs apart whose first halves agree
        parts = [np.sort(substring_dedup._pairs(p // np.uint64(9), p % np.uint64(9)), order=["a", "b"]) for p in parts]
    count = Counter(v for p in parts for v in p.tolist())
    table = pa.table({"chunk": pa.array(range(30), pa.int32()), "payload": pa.array([p.tobytes() for p in parts], pa.binary())})
    out = substring_dedup._answer(kind)(table)
    got = {c: np.frombuffer(v, kind).tolist() for c, v in zip(out.column("chunk").to_pylist(), out.column("payload").to_pylist(), strict=True)}
    want = {i: sorted({v for v in p.tolist() if count[v] > 1}) for i, p in enumerate(parts)}
    assert got == {i: v for i, v in want.items() if v}
