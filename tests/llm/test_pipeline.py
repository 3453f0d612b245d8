import random
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from test_joins import components, repeats

EN = "the of and to in is that it was for on are as with his they at be this from".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(9)
    make = lambda w, n: " ".join(rng.choice(w) + rng.choice(["", "", "n", "s", "t"]) for _ in range(n))
    passage = make(EN, 60)
    rows = [(i, make(EN if i % 3 else DE, rng.randrange(40, 200)), "en" if i % 3 else "de", f"s{i % 4 if i % 5 else 9}") for i in range(120)]
    rows += [(200 + i, make(EN, 50) + " " + passage + " " + make(EN, 30), "en", "s1") for i in range(4)]
    rows += [(300, rows[5][1], "en", "s2"), (301, rows[5][1] + " end", "en", "s2"), (302, "123 456", None, "s1"), (303, None, None, "s1"), (304, "", None, None), (None, make(EN, 80), "en", None)]
    path = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([(*r[:4], len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    df.write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, table)
    assert known.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in known.collect()} == {302, 303, 304}
    before = [(r["doc_id"], r["text"]) for r in known.collect()]
    kept = stages["ngram_jaccard_join"](spark, known, table)
    heads = Counter(d for (d, _, c) in components(before, 5, 8, 10).elements() if d is None or d == c)
    assert Counter(r["doc_id"] for r in kept.collect()) == heads and kept.columns == docs.columns
    assert not {300, 301} & set(heads) and 5 in heads
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    cut = stages["substring_dedup"](spark, kept, table)
    lost = {d: n for d, _, n, _ in repeats(rows, 35) if n}
    texts = dict(rows)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert set(got) == set(texts) and set(lost) == {200, 201, 202, 203}
    for d, r in got.items():
        assert r["n_chars"] == len(r["text"])
        assert len(r["text"].split()) == len(texts[d].split()) - lost.get(d, 0) and (d in lost or r["text"] == texts[d])
    mixed = stages["source_mixing"](spark, cut, table)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in cut.collect()}
    pieces = stages["best_fit_packing"](spark, mixed, table).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def test_short_documents_stay(spark):
    rng = random.Random(4)
    # Languages with the same words: no text is more sure than one of four.
    rows = [(i, " ".join(rng.choice(EN) for _ in range(40)), f"l{i % 4}") for i in range(80)]
    rows += [(100 + i, t, None) for i, t in enumerate(["This.", "A.", "Re.", "In. The.", "is as", "12 %", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "").collect()}
    assert got == set(range(80)) | {100, 101, 102, 103, 104}


def test_run(spark, table, tmp_path):
    assert corpus_pipeline.run(spark, table).count() > 0 and 4 <= len(corpus_pipeline.STAGES) <= 5
    empty = str(tmp_path / "none")
    spark.read.parquet(f"{table}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_each_stage_begins_with_collected_heaps(spark, table):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.read.parquet(f"{table}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, table)
        assert full() > before, name


def test_mixing_starts_no_python_workers(tmp_path):
    run = """
import psutil
from pyspark.sql import SparkSession, functions as F
from sluice.llm import mixing
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("a b c").alias("text"))
assert mixing.mix(docs, target_entropy_share=0.97).count() > 100
print("workers:", sum("pyspark.daemon" in " ".join(p.cmdline()) for p in psutil.Process().children(recursive=True)))
"""
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert "workers: 0" in out.stdout, out.stdout + out.stderr[-2000:]
