import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import experiments, lists, metrics
from sluice.plans import policy
from sluice.sources import readers, writers


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a.com", "games"), ("b.com", "cl\"ean")], "domain string, label string")
    writers.labels(rows, str(tmp_path / "l"))
    assert {(r["domain"], r["label"]) for r in readers.labelled_domains(spark, str(tmp_path / "l")).collect()} == {("a.com", "games"), ("b.com", 'cl"ean')}
    df = spark.createDataFrame([(1, "é x", "train", None), (2, "y", "test", "adult")], "id int, text string, split string, contamination string")
    writers.splits(df.drop("contamination"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "split=train")).first()["text"] == "é x"
    assert writers.quarantine(df, str(tmp_path / "q")) and not writers.quarantine(df.where("id = 1"), str(tmp_path / "none"))
    assert spark.read.json(str(tmp_path / "q" / "kept")).count() == 1 and not (tmp_path / "none").exists()
    for i in (1, 2):
        writers.append_log(df.where(f"id = {i}"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    writers.commit(spark, str(tmp_path / "pub"), "v1", {"a": 1})
    writers.commit(spark, str(tmp_path / "pub"), "v2", {"a": 2})
    assert (tmp_path / "pub" / "CURRENT").read_text() == "v2" and readers.manifest(spark, str(tmp_path / "pub" / "v1")) == {"a": 1, "version": "v1"}
    events = spark.createDataFrame([(1, 1, 'q"x', "games", "list"), (2, 2, "b", "games", "list")], "t long, seq long, domain string, category string, source string")
    writers.report_csv(events, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv" / "domain").glob("*.csv"))
    assert text.splitlines()[0] == '"key","n"' and '"q""x","1"' in text
    assert json.loads(writers.report_json(events, "now").first()[0])["exported"] == "now"


def test_scans_and_network_blocks(spark):
    schema = "id int, url string, real_host string, frame int, text string, lang string, cat string, structural struct<has_video_player:boolean,has_age_gate:boolean,url_embeds_url:boolean,fp_proxy_marker_count:int,has_url_like_input:boolean,paragraph_count:int,has_large_xorigin_iframe:boolean,has_gambling_license_seal:boolean,has_payment_field:boolean,has_dominant_canvas:boolean>"
    video, bare = (True, False, False, 0, False, 0, False, False, False, False), (False, False, False, 0, False, 9, False, False, False, False)
    rows = [(1, "https://a.com/x", None, 0, "t", "en", "adult", video), (2, "https://a.com/x", None, 1, "t", "en", "adult", video), (3, "about:blank", "b.com", 0, "t", "en", "adult", bare), (4, "https://ok.com/", None, 0, "t", "en", "adult", video), (5, "https://www.google.com/search", None, 0, "t", "en", "adult", video), (6, "https://c.com/", None, 0, "一丁丂七" * 50, "en", "clean", bare), (7, "https://c.com/", None, 0, "t", "en", "clean", bare)]
    scans = spark.createDataFrame(rows, schema)
    decision = F.when(F.col("cat") != "clean", F.struct(F.col("cat").alias("category"), F.lit(0.99).alias("confidence")))
    allow = spark.createDataFrame([("ok.com",)], "domain string")
    got = {r["id"]: (r["host"], r["action"], r["category"], r["pin"]) for r in policy.scan_verdicts(scans, allow, decision).collect()}
    assert got == {1: ("a.com", "block", "adult", True), 2: ("a.com", "block", "adult", False), 3: ("b.com", "block", "adult", False), 4: ("ok.com", "allow", None, False), 5: ("www.google.com", "allow", None, False), 6: ("c.com", "block", "proxy-bypass", False), 7: ("c.com", "allow", None, False)}
    errors = spark.createDataFrame([(1, "https://x.bad.com/", 0, "net::ERR_BLOCKED_BY_CLIENT"), (2, "https://x.bad.com/", 1, "net::ERR_BLOCKED_BY_CLIENT"), (3, "https://x.bad.com/", 0, "net::ERR_FAILED"), (4, "https://own.org/", 0, "net::ERR_BLOCKED_BY_CLIENT"), (5, "https://odd.net/", 0, "net::ERR_BLOCKED_BY_CLIENT")], "id int, url string, frame int, error string")
    tail = lists.tail_table(spark.createDataFrame([("bad.com", 4)], "domain string, cat int"))
    block = spark.createDataFrame([("own.org",)], "domain string")
    assert {r["id"]: (r["category"], r["source"]) for r in policy.network_blocks(errors, tail, block).collect()} == {1: ("4", "list"), 4: ("district-policy", "district-policy"), 5: ("uncategorized", "list")}


def test_experiments(spark):
    rows = [(i, "a", f"alpha beta x{i % 3}") if i % 2 else (i, "clean", f"gamma delta x{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    curve = experiments.learning_curve(df, df, ["a", "clean"], (10, 30), id_col="id", text_col="text")
    assert [c["rows"] for c in curve] == [10, 30] and curve[-1]["accuracy"] == 1.0
    out = experiments.stacked(df, id_col="id", text_col="text", folds=2)
    assert out.count() == 60 and out.groupBy("id").agg(F.max_by("class", "score").alias("c")).join(df, "id").where("c = label").count() >= 28
    scored = spark.createDataFrame([("clean", "a", 0.2), ("clean", "a", 0.96), ("a", "a", 0.9), ("a", "a", 0.99)], "y_true string, best string, confidence double")
    best = experiments.at_budgets({"m": scored}, (0.0, 0.5))
    assert best[0]["recall"] == 0.5 and best[0]["threshold"] > 0.96 and best[1]["recall"] == 1.0 and best[1]["threshold"] == pytest.approx(0.3)
    suite = experiments.suite(spark.createDataFrame([("u", "adult"), ("v", "clean"), ("w", "games")], "url string, label string"), spark.createDataFrame([("u", "games"), ("v", "games")], "url string, category string"))
    assert {r["url"]: r["ok"] for r in suite.collect()} == {"u": True, "v": False, "w": False}
    assert metrics.sweep(scored.limit(0), (0.5,)).collect()[0]["recall"] == 0.0


