import hashlib

import pytest

from sluice.llm import fingerprints


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(5, "one two three four five six", "e"), (1, "one two three four five six", "e"), (9, None, "e"), (3, "", "e"), (-2, "☃ é snow man on the hill", "e"), (None, "no id here", "e"), (9, "later", "e"), (100, "x " * 5000, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


@pytest.mark.parametrize("parts", ["1", "4", "50"])
def test_next_documents(spark, docs, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.edited_likeness(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, t in rows:
        after = [x for j, x in rows if (j is not None and i is None) or (j is not None and i is not None and j > i)]
        other = after[0] if after else rows[0][1]
        want.append((i, len(t), hashlib.sha256(fingerprints.half_edited(t, other).encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[5] == prints[1] and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_votes_and_likeness(docs):
    """Every bit by a loop over the terms, and both likeness columns by the fingerprints of the texts they compare."""
    import math
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from sluice.llm._text import hash_words, mix, shingle_hashes, text_buffer

    def print_of(t):
        data, offsets = text_buffer(pa.array([t]))
        words = hash_words(data, offsets).h
        times = Counter(shingle_hashes(words, fingerprints.SHINGLE).tolist()) if len(words) else {}
        bits = [0] * 256
        for term, n in times.items():
            lanes = b"".join(int(mix(np.array([term], np.uint64) ^ lane)[0]).to_bytes(8, "little") for lane in fingerprints._LANES[:4])
            for k in range(256):
                bits[k] += (1 + math.floor(math.log2(n))) * (1 if lanes[k // 8] >> (7 - k % 8) & 1 else -1)
        return int("".join("1" if b > 0 else "0" for b in bits), 2).to_bytes(32)

    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null and doc_id <> 9").collect()))
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs.where("doc_id is not null and doc_id <> 9")).collect()}
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        edited = fingerprints.half_edited(t, other)
        a, b, c = print_of(t), print_of(edited), print_of(other)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a.hex(), b.hex())
        assert got[i]["near_edited"] == fingerprints.likeness(a, b) and got[i]["near_next"] == fingerprints.likeness(a, c)


def test_no_documents(docs):
    assert fingerprints.edited_likeness(docs.limit(0)).collect() == []


def test_radius_search(spark):
    import random

    rng = random.Random(3)
    base = [bytes(rng.randrange(256) for _ in range(32)) for _ in range(20)]

    def flipped(x, n):
        v = int.from_bytes(x)
        for b in rng.sample(range(256), n):
            v ^= 1 << b
        return v.to_bytes(32)

    table = base + [flipped(b, n) for b in base for n in (1, 3, 6, 7)] + base[:5]
    df = spark.createDataFrame([(x,) for x in table] + [(None,)], "fingerprint binary")
    got = {(bytes(r["query"]), bytes(r["near"])): r["distance"] for r in fingerprints.near_fingerprints(df, df, 6).collect()}
    kinds = set(table)
    distance = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    assert got == {(a, b): distance(a, b) for a in kinds for b in kinds if a != b and distance(a, b) <= 6}


def test_edits_are_nearer_than_others():
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    a, b = " ".join(words[:200]), " ".join(words[200:])
    import pyarrow as pa

    own, edited, other = fingerprints.fingerprint_texts(pa.array([a, fingerprints.half_edited(a, b), b]), 256)
    assert fingerprints.likeness(own, edited) > fingerprints.likeness(own, other) + 0.08
