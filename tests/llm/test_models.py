import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import language_id, toxicity
from sluice.llm._text import text_buffer

EN = "the of and to in is that it was for on are as with his they at be this from".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()


def brute_bits(train, text, table):
    """Code length of a text by PPM with method C, straight from counted contexts."""
    counts = {}

    def symbols(t):
        out = [0]
        for b in t.encode():
            s = int(table[b])
            if s or out[-1]:
                out.append(s)
        return out[1:]

    def feed(t, f):
        s = [0, 0, 0, *symbols(t)]
        for i in range(3, len(s)):
            f(tuple(s[i - 3 : i]), s[i])

    def learn(c, x):
        for k in range(3):
            counts.setdefault(c[3 - k :] if k else (), {}).setdefault(x, 0)
            counts[c[3 - k :] if k else ()][x] += 1
        counts.setdefault(c, {}).setdefault(x, 0)
        counts[c][x] += 1

    for t in train:
        feed(t, learn)
    total = 0.0

    def cost(c, x):
        nonlocal total
        for k in range(3, -1, -1):
            seen = counts.get(c[3 - k :] if k else ())
            if seen is None:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if x in seen:
                total -= math.log2(seen[x] / (n + kinds))
                return
            total -= math.log2(kinds / (n + kinds))
        total += math.log2(64)

    feed(text, cost)
    return total


def test_code_lengths_are_those_of_counted_contexts(spark):
    rng = random.Random(2)
    texts = {lang: [" ".join(rng.choice(w) for _ in range(30)) for _ in range(6)] for lang, w in (("en", EN), ("de", DE))}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probes = ["the für  42 zzz", "", "und", "Ω the!", "x" * 50]
    data, offsets = text_buffer(pa.array(probes))
    got = m.code_lengths(data, offsets, m.index())
    for k, lang in enumerate(m.languages):
        for i, t in enumerate(probes):
            assert got[i, k] == pytest.approx(brute_bits(texts[lang], t, m.table), rel=1e-4, abs=1e-3)
    long = " ".join(rng.choice(EN) for _ in range(3000))
    data, offsets = text_buffer(pa.array([long]))
    assert np.allclose(m._long(data, m.index(), 1000), m.code_lengths(data, offsets, m.index())[0], rtol=1e-6)


def test_languages(spark):
    rng = random.Random(1)
    make = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    learn = [(i, make(EN, 40), "en") for i in range(30)] + [(i, make(DE, 40), "de") for i in range(30, 60)] + [(99, None, "en"), (98, "x", None)]
    rows = [(1, make(EN, 20)), (2, make(DE, 20)), (3, None), (4, ""), (5, "12 %& 3"), (6, "— ½"), (None, make(DE, 20)), (1, make(EN, 9)), (7, make(EN, 60_000)), (8, "好")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    m = language_id.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, m).collect()]
    assert got[:9] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "und"), (None, "de"), (1, "en"), (7, "en")] and got[9][1] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in language_id.predict(docs, m).collect())
    assert language_id.predict(docs.limit(0), m).collect() == []
    empty = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}


def labelled(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("an", "ou", "thi", "en", "ra") for b in ("ter", "ing", "ed", "ly", "on")]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        for _ in range(2 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "worthless", "SCUM!"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity(spark):
    rows = labelled(1, 600)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(None, "idiot scum", 0), (1000, None, 0), (1001, "", 0), (0, rows[0][1], 0)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(None, 1), (2, None)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, m).collect()}
    assert len(toxicity.score(docs, m).collect()) == 604
    held = [(got[i]["predicted"], y) for i, _, y in rows if i >= 400]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[1000]["predicted"] == 0 and got[1001]["score"] == got[1000]["score"] and got[None]["predicted"] == 1
    assert got[500]["evidence"] and toxicity.score(docs.limit(0), m).collect() == []
    none = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_stems_of_a_small_language_stay():
    rng = random.Random(8)
    make = lambda w, n: [rng.choice(w) + rng.choice(["", "ka", "lo", "mi"]) for _ in range(n)]

    def rows(n):
        out = []
        for i in range(n):
            small, bad = i % 5 == 0, i % 6 == 0
            w = make(DE if small else EN, 900 if small and i % 4 == 3 else rng.randrange(40, 80))
            if small and i % 4 == 3:  # a long clean text has the stem by chance
                w[::300] = ["bomen", "bomenka", "bomenlo"]
                bad = False
            for _ in range(6 if bad else 0):
                w.insert(rng.randrange(len(w)), "bomen" + rng.choice(["", "ka", "lo"]) if small else rng.choice(["idiot", "scum"]))
            out.append((" ".join(w), int(bad), small))
        return out

    learn, held = rows(900), rows(300)
    y = np.array([y for _, y, _ in learn])
    stem = np.array([" bomen" in " " + t for t, *_ in learn])
    assert 2 < stem[y == 1].mean() / stem[y == 0].mean() < 20
    m = toxicity.fit([t for t, *_ in learn], y, list(range(900)), float(y.mean()))
    data, offsets = text_buffer(pa.array([t for t, *_ in held]))
    doc, term, weight = m.vectors(data, offsets)
    got = [m.score(m.vote(*m.index.nearest(term[doc == i], weight[doc == i], toxicity.NEIGHBOURS))) >= 0.7 for i in range(300)]
    assert got == [bool(y) for _, y, _ in held]


def copies(n, group, seed=5):
    """Rows whose toxic kind is in a few, beside `group` near copies of one toxic text of plain words."""
    rng = random.Random(seed)
    plain = lambda k: [rng.choice(EN) + rng.choice(DE) for _ in range(k)]
    one, out = plain(80), []
    for i in range(n):
        w, bad = plain(rng.randrange(30, 60)), i % 10 == 0
        if bad:
            w[::9] = ["scum" if i % 200 == 0 else "idiot"] * len(w[::9])
        out.append((" ".join(w), int(bad)))
    for _ in range(group):
        w = list(one)
        w[rng.randrange(80)] = rng.choice(EN)
        out.append((" ".join(w), 1))
    return out, one, plain


def test_copies_count_once_and_find_each_other():
    rows, one, plain = copies(1200, 600)
    y = np.array([y for _, y in rows])
    m = toxicity.fit([t for t, _ in rows], y, list(range(len(rows))), float(y.mean()))
    other = list(one)
    other[3], other[40] = "theder", "zuof"
    probes = [" ".join(one), " ".join(other), " ".join(plain(50) + ["scum"] * 6), " ".join(plain(50) + ["idiot"] * 6), " ".join(plain(50)), ""]
    data, offsets = text_buffer(pa.array(probes))
    doc, term, weight = m.vectors(data, offsets)
    got = [m.score(m.vote(*m.index.nearest(term[doc == i], weight[doc == i], toxicity.NEIGHBOURS))) >= 0.7 for i in range(len(probes))]
    assert got == [True, True, True, True, False, False]


def test_sample_is_of_distinct_texts(spark):
    rows, *_ = copies(600, 600)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, toxic=60, clean=200)
    drawn = m.names[m.labels == 1]
    assert (drawn < 600).sum() > 0.4 * len(drawn) and len(drawn) > 25


def test_neighbours_are_exact():
    rows = labelled(3, 500)
    m = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), [i for i, *_ in rows], 0.2)
    dense = np.zeros((500, len(m.keys) + 1))
    data, offsets = text_buffer(pa.array([t for _, t, _ in rows]))
    doc, term, weight = m.vectors(data, offsets)
    dense[doc, term] = weight
    assert np.allclose((dense**2).sum(1), 1)
    for i in range(0, 500, 17):
        ids, cosines = m.index.nearest(term[doc == i], weight[doc == i], 15)
        all_cosines = dense @ dense[i]
        bound = np.sort(all_cosines)[-15]
        assert set(np.flatnonzero(all_cosines >= bound + 1e-9)) <= set(ids.tolist()) <= set(np.flatnonzero(all_cosines >= bound - 1e-9))
        assert np.allclose(cosines, all_cosines[ids])
