import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import blocklog
from sluice.streaming import state

pytest.importorskip("google.protobuf")


def run(spark, tmp_path, schema, batches, make, mode="append"):
    """Rows of a stream over `batches`, written file by file, in memory."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    name = f"t{random.randrange(10**9)}"
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


EVENT = "tab long, t long, seq long, domain string, category string, source string"


def events(seed, n=60):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([500, 2999, 3000, 7000])
        out.append((rng.randrange(2), t, i, rng.choice("ab"), rng.choice(["games", "adult"]), "list"))
    return out


def test_stream_logs_as_a_batch(spark, tmp_path):
    rows = events(1)
    got = run(spark, tmp_path, EVENT, [rows[:20], rows[20:45], rows[45:]], state.logged)
    want = blocklog.logged(spark.createDataFrame(rows, EVENT))
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in want.collect())


def test_stream_counts_as_a_batch(spark, tmp_path):
    rows = events(2)
    got = run(spark, tmp_path, EVENT, [rows[:30], rows[30:]], state.counters, "complete")
    want = spark.createDataFrame(rows, EVENT).groupBy(blocklog.utc_day(F.col("t")).alias("day"), "category", "source").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_attribution(spark, tmp_path):
    schema = "tab long, t long, seq long, kind string, host string"
    first = [(1, 1, 1, "nav", "a.com"), (2, 2, 2, "scan", None), (1, 3, 3, "scan", None)]
    second = [(1, 4, 4, "scan", ""), (1, 5, 5, "closed", None), (1, 6, 6, "scan", None), (2, 7, 7, "nav", "b.com")]
    got = run(spark, tmp_path, schema, [first, second], state.attributed)
    assert {r["seq"]: r["real_host"] for r in got.collect()} == {1: "a.com", 2: None, 3: "a.com", 4: "a.com", 6: None, 7: "b.com"}


def test_pins_throttle_and_rate(spark, tmp_path):
    pins = [[("a", "games", 0.9, 5, 1), ("a", "adult", 0.9, 4, 2)], [("a", "x", 0.9, 9, 3), ("b", "x", 0.8, 9, 4)]]
    got = run(spark, tmp_path / "p", "host string, category string, confidence double, t long, seq long", pins, state.first_pins)
    assert {r["host"]: r["category"] for r in got.collect()} == {"a": "adult", "b": "x"}
    scans = [[("p", 0, 1, "s1"), ("p", 3999, 2, "s2"), ("p", 4000, 3, "s1")], [("p", 4000, 4, "s3"), ("p", 9000, 5, "s4"), ("p", 20000, 6, "s5")]]
    got = run(spark, tmp_path / "s", "page string, t long, seq long, signature string", scans, lambda d: state.throttled(d, most=3))
    assert sorted(r["seq"] for r in got.collect()) == [1, 4, 5]
    asked = [[(1, 0, 1), (1, 59_999, 2)], [(1, 60_000, 3), (1, 119_999, 4), (2, 1, 5)]]
    got = run(spark, tmp_path / "r", "tab long, t long, seq long", asked, state.rate_limited)
    assert {r["seq"]: r["accepted"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    flat = spark.createDataFrame([r for b in asked for r in b], "tab long, t long, seq long")
    assert {r["seq"]: r["accepted"] for r in blocklog.rate_limited(flat).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
