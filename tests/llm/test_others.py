import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import ann, chat, mixing


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<s>/[INST]\\ab\n", max_size=40), st.text(alphabet="<s>/[INST]\\ab", max_size=10))
def test_escapes_come_back(text, role):
    written, a, b = chat.format_turn(role, text)
    assert chat.unescape(written[a:b]) == text and chat.parse(written + written) == [(role, text)] * 2
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello <s>"), (1, 3, "user", "more"), (1, 4, "assistant", None), (1, 5, "user", "bye"), (2, 0, "assistant", "é☃"), (3, None, "user", "x"), (3, 0, None, "y"), (None, 1, "assistant", "z"), (-1, 0, "user", said), (-1, 1, "assistant", said), (4, 0, "assistant", "b"), (4, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    for c, turns in by.items():
        r = got[c]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat.expand(df).where("conv_id = 1").orderBy("example").collect()
    assert len(examples) == 3 and len({e["text"] for e in examples}) == 3
    assert chat.unescape(examples[0]["text"][examples[0]["loss_start"] : examples[0]["loss_end"]]) == "hello <s>"
    assert chat.digest(chat.expand(df.limit(0))).collect() == []


def test_temper():
    tokens = {"a": 800, "b": 150, "c": 50}
    power, w = mixing.temper(tokens, 1000, most_repeats=2.0)
    assert 0 < power < 1 and max(w[s] * 1000 / tokens[s] for s in tokens) == pytest.approx(2.0)
    power, w = mixing.temper(tokens, 1000, target_entropy=1.2)
    assert mixing.entropy(w) == pytest.approx(1.2) and sum(w.values()) == pytest.approx(1)
    assert mixing.temper(tokens, 1000)[0] == 0 and mixing.temper({"a": 0}, 10)[1] == {"a": 0.0}
    assert mixing.temper({}, 10) == (1.0, {})


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, f"s{min(rng.randrange(9), 4)}" if i % 50 else None, " ".join(["w"] * rng.randrange(0, 30))) for i in range(2000)] + [(7, "s1", "a b c"), (None, "s1", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, mix_order int")
    got = mixing.mix(docs.drop("mix_order"), target_entropy_share=0.98, most_repeats=5.0).collect()
    total, drawn, copies = Counter(), Counter(), defaultdict(Counter)
    for _, s, t in rows:
        total[s] += len((t or "").split())
    for r in got:
        drawn[r["source"]] += r["mix_tokens"]
        copies[r["source"]][(r["doc_id"], r["text"], r["mix_epoch"])] += 1
    share = 0.98 * np.log2(sum(t > 0 for t in total.values()))
    _, w = mixing.temper({str(s): t for s, t in total.items()}, sum(total.values()), target_entropy=share, most_repeats=5.0)
    for s, t in total.items():
        assert 0 <= w[str(s)] * sum(total.values()) - drawn[s] < 31, s
        assert t
    full = {s: int(w[str(s)] * sum(total.values())) // t for s, t in total.items()}
    for i, s, t in rows:
        for e in range(full[s]):
            assert copies[s][(i, t, e)] >= 1  # whole epochs hold every document
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["key", "full", "low", "part", "head", "place", "mix_tokens", "__source"])])
    clashing = mixing.mix(wide, target_entropy_share=0.98, most_repeats=5.0)
    assert len(set(clashing.columns)) == len(clashing.columns) == 3 + 7 + 4
    assert Counter((r["doc_id"], r["text"], r["mix_epoch"], r["mix_order"], r["mix_tokens"]) for r in got) == Counter((r["doc_id"], r["text"], r["mix_epoch"], r["mix_order"], r["mix_tokens"]) for r in clashing.collect())
    again = mixing.mix(docs.drop("mix_order"), target_entropy_share=0.98, most_repeats=5.0).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs.drop("mix_order").limit(0)).collect() == []


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype("f4")
    x[100:900] = x[100]  # one vector for a quarter of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), shard=700).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    y, hits = x.astype("f8"), 0
    queries = range(0, 3000, 100)
    for q in queries:
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = sorted((s, i) for i, s in enumerate(d.tolist()) if i != q)[:10]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        assert all(s == pytest.approx(d[i], abs=1e-12) for s, i in got[q])
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        if 100 <= q < 900:
            assert got[q] == want
    assert hits >= 0.9 * 10 * len(queries) and set(got) == set(queries)
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, few.where("vec_id = 1")).collect()] == [(1, 1, 2, pytest.approx(2**0.5))]
    assert ann.nearest(few.limit(0), few.limit(0)).collect() == [] and few.where(~ann.usable(F.col("embedding"))).count() == 0


def test_recall_on_vectors_without_structure():
    """Unit vectors at random in 64 dimensions, which are the hardest: recall and the share measured, by brute force."""
    rng = np.random.default_rng(8)
    for n, most in ((500, 0.4), (3000, 0.2)):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, hits, measured = range(0, n, n // 60), 0, 0
        found = ann.Forest(x).candidates(x[list(q)], int(ann.CANDIDATES * n) + ann.MORE * 10)
        for i, f in zip(q, found, strict=True):
            d = ((x - x[i]) ** 2).sum(1)
            hits += len(set(np.argsort(d)[1:11].tolist()) & set(f.tolist()))
            measured += len(f)
        assert hits >= 0.93 * 10 * len(q) and measured < most * n * len(q)


def test_a_source_whose_quota_is_its_tokens_is_drawn_in_full(spark):
    # Nearly uniform: no power meets the entropy target, so each weight is the source's own share.
    rows = [(10 * s + i, f"s{s}", " ".join(["w"] * (50 + s + i))) for s in range(30) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r["doc_id"] for r in mixing.mix(docs, target_entropy_share=0.97).collect()]
    assert sorted(got) == sorted(d for d, *_ in rows)
