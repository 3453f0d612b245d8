import io
import json
import random
import tarfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sluice.functions.text import hex64
from sluice.operators import blocklog, corpus, experiments, lists, lookup, metrics, records, scoring
from sluice.plans import compile as plans
from sluice.plans import policy, sync
from sluice.sources import readers, remote, writers

SOURCES = [
    ("games.example.com", 0, 0, 0), ("a.games.example.com", 0, 0, 1), ("games.example.com", 1, 0, 0), ("b.games.example.com", 1, 0, 1),
    ("bet.example.net", 1, 1, 0), ("x.allowed.org", 0, 1, 0), ("allowed.org", 0, 1, 1), ("z.example.org", 2, 0, 0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(SOURCES, "domain string, cat int, src int, seq long")


def test_compile(spark, rows, tmp_path):
    block = spark.createDataFrame([("own.example.com", 0), ("bet.example.net", 1)], "domain string, seq long")
    allow = spark.createDataFrame([("allowed.org",)], "domain string")
    ranks = spark.createDataFrame([("z.example.org", 1), ("games.example.com", 7)], "domain string, rank long")
    out = plans.compile_lists(rows, block=block, allow=allow, ranks=ranks, custom=3, max_domains=4, domains_per_rule=2, rules_per_chunk=1)
    assert {(r["domain"], r["cat"]) for r in out.table.collect()} == {("games.example.com", 0), ("b.games.example.com", 1), ("bet.example.net", 1), ("z.example.org", 2), ("own.example.com", 3)}
    assert [r["domain"] for r in out.tier.orderBy("pos").collect()] == ["z.example.org", "games.example.com", "b.games.example.com", "bet.example.net"]
    bodies = lists.rule_bodies(out.rules)
    files = writers.rule_chunks(spark, bodies, str(tmp_path / "dnr"))
    assert [(f["file"], f["ruleIdStart"], f["ruleCount"], f["domains"]) for f in files] == [("000.json", 1, 1, 2), ("001.json", 2, 1, 2)]
    rule = json.loads((tmp_path / "dnr" / "001.json").read_text())[0]
    assert rule == {"id": 2, "priority": 1, "action": {"type": "block"}, "condition": {"requestDomains": ["b.games.example.com", "bet.example.net"], "resourceTypes": ["main_frame", "sub_frame"]}}
    tail = [r["h"] & (2**64 - 1) for r in out.tail.collect()]
    assert tail == sorted(tail)
    hashes, cats = writers.tail_binary(out.tail)
    assert len(hashes) == 8 * len(cats) == 40
    v = writers.content_version(out.tail, ["a"], files)
    assert v == writers.content_version(out.tail, ["a"], files) != writers.content_version(out.tail.where("cat < 3"), ["a"], files)
    with pytest.raises(ValueError):
        plans.compile_lists(rows.limit(0))


def test_pruning_twice_is_pruning_once(rows):
    once = lists.without_covered(lists.first_wins(rows))
    assert sorted(map(tuple, lists.without_covered(once).collect())) == sorted(map(tuple, once.collect()))


def test_rules_keep_their_bytes(spark):
    domains = [(i, "d" * (i % 60) + f"{i}.example.com") for i in range(400)]
    packed = lists.pack_rules(spark.createDataFrame(domains, "pos long, domain string"), max_rules=10**6).collect()
    by = {}
    for r in packed:
        by.setdefault(r["rule_id"], []).append((r["pos"], r["domain"]))
    assert len(packed) == 400 and [p for k in sorted(by) for p, _ in sorted(by[k])] == list(range(400))
    for k in sorted(by):
        assert 140 + sum(len(d) + 3 for _, d in by[k]) <= 1800 and len(by[k]) <= 60


def test_longest_suffix(spark):
    hosts = spark.createDataFrame([("a.b.example.com",), ("b.example.com",), ("example.com",), ("other.net",), (None,)], "host string")
    table = spark.createDataFrame([("example.com", 1), ("b.example.com", 2)], "domain string, cat int")
    got = {r["host"]: (r["matched"], r["cat"]) for r in lookup.longest_listed(hosts, lists.tail_table(table)).collect()}
    assert got == {"a.b.example.com": ("b.example.com", 2), "b.example.com": ("b.example.com", 2), "example.com": ("example.com", 1)}


def test_navigations(spark):
    nav = spark.createDataFrame([(1, "https://bad.example.com/", 0), (2, "https://bad.example.com/", 1), (3, "https://ok.bad.example.com/", 0), (4, "https://p.example/x/https%3A%2F%2Fa.example", 1), (5, "https://pinned.net/", 0), (6, "https://shared.net/", 0), (7, "https://district.org/", 0), (8, "about:blank", 0)], "nav int, url string, frame int")
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "domain string")
    tail = lists.tail_table(spark.createDataFrame([("bad.example.com", 3)], "domain string, cat int"))
    pins = spark.createDataFrame([("pinned.net", "adult"), ("x.shared.net", "games")], "host string, category string")
    got = {r["nav"]: (r["action"], r["category"], r["source"]) for r in policy.navigation_verdicts(nav, tail, one("ok.bad.example.com"), one("district.org"), pins, spark.createDataFrame([("shared.net",)], "host string")).collect()}
    assert got == {1: ("block", "3", "list"), 2: ("allow", None, None), 3: ("allow", None, None), 4: ("block", "proxy-bypass", "proxy"), 5: ("block", "adult", "model"), 6: ("allow", None, None), 7: ("block", "district-policy", "district-policy"), 8: ("allow", None, None)}


def test_usable(spark):
    long = "enough words to be a page " * 5
    cases = [("", "", long, True), ("", "", "short", False), ("one two three", "four five six", "", True), ("", "", long + " RAY ID: 7", False), ("Domain is for sale", "", long, False), (None, None, None, False)]
    df = spark.createDataFrame([(t, m, b, ok) for t, m, b, ok in cases], "title string, meta string, text string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(corpus.is_usable(F.col("title"), F.col("meta"), F.col("text")), "ok").collect())


def test_contamination(spark):
    cases = {"play casino and poker here": "gambling", "casino only": None, "alphabetting essex slothful": None, "free porn videos": "adult", "unblock glype casino poker": "gambling", "": None, None: None, "browser games and io games": "games"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want string")
    assert all(r[0] == r[1] for r in df.select(corpus.contamination(F.col("text")), "want").collect())


def greedy(rows):
    kept = {}
    for g, seq, h in sorted(rows, key=lambda r: r[1]):
        if all((h ^ k).bit_count() > 4 for k in kept.setdefault(g, {}).values()):
            kept[g][seq] = h
    return {s for k in kept.values() for s in k}


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_as_in_one_pass(spark, seed):
    rng = random.Random(seed)
    base, rows = [rng.getrandbits(63) for _ in range(8)], []
    for i in range(160):  # chains: each differs in few bits from one before
        h = rng.choice(base)
        for _ in range(rng.randrange(5)):
            h ^= 1 << rng.randrange(63)
        base.append(h)
        rows.append((rng.choice(["x", "y", None]), i, h))
    df = spark.createDataFrame(rows, "g string, seq long, h long")
    assert {r["seq"] for r in corpus.keep_first_of_near(df, "g", "seq", "h").collect()} == greedy(rows)


@pytest.mark.parametrize("first, tile", [(20, 16), (1000, 30)])
def test_near_duplicates_by_tiles(spark, monkeypatch, first, tile):
    monkeypatch.setattr(corpus, "FIRST", first)
    monkeypatch.setattr(corpus, "GROWTH", 3)
    monkeypatch.setattr(corpus, "TILE", tile)
    monkeypatch.setattr(corpus, "MOST_TASKS", 4)
    rng, rows = random.Random(first), []
    for i in range(300):
        h = rng.choice([0, 2**63 - 1, -(2**63), 0x5555555555555555])
        for _ in range(rng.randrange(7)):
            h ^= 1 << rng.randrange(63)
        rows.append((rng.choice(["x", "x", "x", "y", None, str(i % 90)]), 1000 - i, h))
    df = spark.createDataFrame(rows, "g string, seq long, h long")
    unsigned = [(g, s, h % 2**64) for g, s, h in rows]
    assert {r["seq"] for r in corpus.keep_first_of_near(df, "g", "seq", "h").collect()} == greedy(unsigned)
    assert corpus.keep_first_of_near(df.limit(0), "g", "seq", "h").collect() == []


def test_near_duplicates_in_a_dense_place_bring_few_pairs(spark, monkeypatch):
    from sluice.plans.session import stored

    monkeypatch.setattr(corpus, "FIRST", 256, raising=False)
    rng = random.Random(5)
    rows = [("x", i, sum(1 << (4 * b) for b in range(15) if h >> b & 1)) for i, h in enumerate(rng.sample(range(1 << 15), 4000))]
    written = []

    def store(df):
        out = stored(df)
        written.append(out.count())
        return out

    kept = corpus.keep_first_of_near(spark.createDataFrame(rows, "g string, seq long, h long"), "g", "seq", "h", store)
    assert {r["seq"] for r in kept.collect()} == greedy(rows)
    assert max(written) < 5 * len(rows)


def test_splits(spark):
    df = spark.createDataFrame([(i, f"k{i % 37}") for i in range(500)], "i int, key string")
    got = corpus.split_by_key(df, "key", (0.8, 0.1, 0.1)).collect()
    kinds = {}
    for r in got:
        assert kinds.setdefault(r["key"], r["split"]) == r["split"]
    assert Counter(kinds.values()) == {"train": 29, "val": 3, "test": 5} and len(got) == 500
    assert Counter(corpus.split_like_shuffle([f"k{i}" for i in range(37)], (0.8, 0.1, 0.1)).values()) == {"train": 29, "val": 3, "test": 5}


def test_prepare(spark):
    body = "a page with more than enough words of its own to be kept number {} {} {} {}"
    rows = [Row(seq=i, etld1=f"s{i % 5}.com", url=f"u{i}", label="clean" if i % 2 else "games", title="t", meta="", text=body.format(*(f"w{i}{k}" * 4 for k in range(4)))) for i in range(20)]
    rows += [Row(seq=20, etld1="s9.com", url="u", label="clean", title="t", meta="", text=rows[1]["text"]), Row(seq=21, etld1="s9.com", url="u", label="clean", title="", meta="", text="casino poker " * 20), Row(seq=22, etld1="s8.com", url="u", label="games", title="", meta="", text="thin")]
    got = plans.prepare(spark.createDataFrame(rows)).collect()
    assert sorted(r["seq"] for r in got) == list(range(20)) and {r["split"] for r in got} >= {"train"}


def test_pools_and_links(spark):
    rows = spark.createDataFrame([("a", "x1.com"), ("a", "x2.com"), ("a", "deny.com"), ("b", "x3.com"), ("b", "f.com")], "label string, domain string")
    ranks = spark.createDataFrame([("x2.com", 5)], "domain string, rank long")
    forced = spark.createDataFrame([("a", "f.com", 0), ("zz", "x1.com", 0)], "label string, domain string, seq long")
    got = [(r["label"], r["domain"]) for r in corpus.pools(rows, ranks, popular_first=("a",), deny=("deny",), forced=forced).orderBy("label", "pos").collect()]
    assert got == [("a", "f.com"), ("a", "x2.com"), ("b", "x3.com")]
    links = spark.createDataFrame([(1, f"https://s.com/{p}", "s.com", "s.com", i) for i, p in enumerate(["", "a", "b?x", "a", "c"])] + [(1, "https://o.com/q", "o.com", "s.com", 9)], "page_id int, link string, link_site string, page_site string, seq int")
    assert corpus.interior_links(links, 10).count() == 3 and corpus.interior_links(links, 2).count() == 2
    anchors = spark.createDataFrame([("Holy Unblocker", "github.io", 0), ("Holy Unblocker", "first.com", 1), ("Holy Unblocker", "holyub.net", 2), ("Zed", "plain.com", 0), ("Zed", "quick.lol", 1)], "provider string, etld1 string, seq int")
    assert {r["provider"]: r["domain"] for r in corpus.pick_anchor(anchors).collect()} == {"Holy Unblocker": "holyub.net", "Zed": "quick.lol"}


def test_log(spark):
    e = spark.createDataFrame([(1, 0, 0, "a"), (1, 2999, 1, "a"), (1, 5999, 2, "a"), (1, 6000, 3, "b"), (1, 6001, 4, "a"), (2, 6001, 5, "a"), (1, 9001, 6, "a")], "tab long, t long, seq long, domain string")
    assert sorted(r["seq"] for r in blocklog.logged(e).collect()) == [0, 2, 3, 4, 5, 6]
    many = e.withColumn("category", F.lit("games")).withColumn("source", F.lit("list"))
    assert {(r["domain"], r["n"]) for r in blocklog.capped_domains(many, 1).collect()} == {("a", 6), ("(other)", 1)}
    assert [(r["day"], r["n"]) for r in blocklog.daily_series(many, "1970-01-02", 2).orderBy("day").collect()] == [("1970-01-01", 7), ("1970-01-02", 0)]
    report = json.loads(writers.report_json(many, "now").first()["json"])
    assert report["stats"]["total"] == 7 and report["stats"]["byCategory"] == {"games": 7} and len(report["recentEvents"]) == 7


def test_metrics_and_gate(spark):
    pairs = spark.createDataFrame([("clean", "clean"), ("clean", "adult"), ("adult", "adult"), ("adult", "clean"), ("games", "adult"), ("odd", "adult")], "y_true string, y_pred string")
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in metrics.per_class(pairs, ["adult", "none"]).collect()}
    assert got == {"adult": (0.25, 0.5, 2), "none": (0.0, 0.0, 0)}
    m = metrics.measure(pairs, ["adult", "games"]).first().asDict()
    assert (m["clean_fp_rate"], m["recall_adult"], m["recall_games"], m["exact_games"], m["wrong_category"]) == (0.5, 0.5, 1.0, 0, 1)
    base = metrics.baseline(m, ["adult", "games"])
    assert base["clean_fp_ceiling"] == 0.51 and base["recall_floor"] == {"adult": 0.47, "games": 0.97} and metrics.gate(m, base) == []
    assert len(metrics.gate(m | {"clean_fp_rate": 0.6, "recall_games": 0.9}, base)) == 2
    assert metrics.fp_rate(pairs.limit(0), "clean").first()[0] == 0.0


def test_models(spark):
    rng = random.Random(0)
    rows = [(i, "games", " ".join(rng.choices(["play", "arcade", "level", "x"], k=12))) if i % 2 else (i, "clean", " ".join(rng.choices(["news", "report", "weather", "x"], k=12))) for i in range(60)] + [(98, "clean", "")]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    vectors = scoring.features(df, "id", "text", 4096).join(df.select("id", "label"), "id")
    assert vectors.count() == 61
    model = scoring.train_text(vectors)
    data, meta = model.save()
    again = scoring.TextModel.load(data, meta)
    scored = scoring.score_text(df, again, "id", "text")
    best = {r["id"]: r["c"] for r in scored.groupBy("id").agg(F.max_by("class", "score").alias("c")).collect()}
    assert sum(best[i] == label for i, label, t in rows if t) >= 59
    sums = scored.groupBy("id").agg(F.sum("score").alias("s")).collect()
    assert len(sums) == 61 and all(abs(r["s"] - 1) < 1e-9 for r in sums)
    dense = df.select("id", "label", (F.col("id") % 2).cast("double").alias("f0"), F.lit(1.0).alias("f1"))
    trees, fitted = scoring.train_trees(dense, ["clean", "games"], ["f0", "f1"], trees=3, depth=2)
    p = {r["id"]: r["scores"] for r in scoring.score_trees(dense, trees, [F.col("f0"), F.col("f1")]).collect()}
    assert all((p[i][1] > p[i][0]) == (label == "games") for i, label, _ in rows)
    result = experiments.bakeoff(df, df, ["clean", "games"], id_col="id", text_col="text", dimensions=(1024,), only=("lr_c4",))
    assert result[0]["accuracy"] > 0.9
    assert scoring.content_id(b"a", {"x": 1, "version": "q"}) == scoring.content_id(b"a", {"x": 1}) != scoring.content_id(b"b", {"x": 1})


def test_tree_walk():
    nodes = [(0, 0.5, 1, 2, 0.0, False, True), (0, 0, 0, 0, 1.0, True, False), (1, 2.0, 3, 4, 0.0, False, False), (0, 0, 0, 0, -1.0, True, False), (0, 0, 0, 0, 5.0, True, False)]
    t = scoring.Trees(["a"], [0.25], [[nodes], [nodes]])
    x = np.array([[0.5, 9], [0.6, 2.0], [0.6, 2.1], [np.nan, 0], [1, np.nan]])
    assert t.raw(x)[:, 0].tolist() == [2.25, -1.75, 10.25, 2.25, 10.25]


def test_boosted_trees_are_sparks(spark):
    rng = random.Random(5)
    rows = [(i, x := rng.random(), y := rng.random(), "a" if x < 0.3 else "b" if y < 0.5 else "c") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    trees, fitted = scoring.train_boosted(df, ["a", "b", "c"], ["x", "y"], rounds=4, depth=3, rate=0.3)
    points = np.array([[r[1], r[2]] for r in rows])
    p = trees.probabilities(points)
    assert np.mean([["a", "b", "c"][k] == r[3] for k, r in zip(p.argmax(1), rows, strict=True)]) > 0.95
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    for k, m in enumerate(fitted):  # a class's own share is that of Spark's model
        own = np.array([r["probability"][1] for r in m.transform(vectors).orderBy("id").collect()])
        assert np.abs(1 / (1 + np.exp(-trees.raw(points)[:, k])) - own).max() < 1e-6
    assert scoring.Trees.load(trees.exported(points)).probabilities(points).tolist() == p.tolist()
    with pytest.raises(ValueError):
        trees.exported(points, p + 1e-3)


def test_frontier_fills_to_its_target(spark):
    pool = spark.createDataFrame([(label, f"{label}{i}.com", i) for label in "ab" for i in range(8)], "label string, domain string, pos long")
    tried, kept = [], []

    def read():
        page = lambda d: (d[0], f"https://{d}/", "", "", "word " * 40)
        return spark.createDataFrame([(d,) for d in tried], "domain string"), spark.createDataFrame([page(d) for d in kept], "label string, url string, title string, meta string, text string")

    def attempt(chosen):
        for r in chosen.collect():
            tried.append(r["domain"])
            if r["label"] == "a" or r["pos"] > 6:  # most of b fail
                kept.append(r["domain"])

    assert records.fill(pool, read, attempt, target=3, batch=2) == 4
    assert sorted(kept) == ["a0.com", "a1.com", "a2.com", "a3.com", "b7.com"] and len(tried) == 12


def test_readers(spark, tmp_path):
    (tmp_path / "hosts").write_text("# list\n0.0.0.0 A.example.com\nbad line here..\n b.example.com\n")
    assert [r["domain"] for r in readers.domain_list(spark, str(tmp_path / "hosts")).orderBy("seq").collect()] == ["a.example.com", "b.example.com"]
    assert readers.lines(spark, str(tmp_path / "none")).count() == 0 and readers.ordinal_ranks(spark, str(tmp_path / "none")) is None
    (tmp_path / "rank.csv").write_text("1,A.com\nx,b.com\n7\n9,a.com\n")
    assert {r["domain"]: r["rank"] for r in readers.ordinal_ranks(spark, str(tmp_path / "rank.csv")).collect()} == {"a.com": 3, "b.com": 2}
    assert {r["domain"]: r["rank"] for r in readers.numbered_ranks(spark, str(tmp_path / "rank.csv")).collect()} == {"A.com": 1, "a.com": 9}
    (tmp_path / "r.jsonl").write_text('{"a": "x y"}\nnot json\n\n{"a": "z"}\n')
    assert {r["a"] for r in readers.json_records(spark, str(tmp_path / "r.jsonl"), "a string").collect()} == {"x y", "z"}
    with pytest.raises(Exception):
        readers.json_records(spark, str(tmp_path / "r.jsonl"), "a string", strict=True).collect()
    (tmp_path / "d.tsv").write_text("a.com\tgames\nno tab\nb.com\tx\ty\n")
    assert [tuple(r)[:2] for r in readers.labelled_domains(spark, str(tmp_path / "d.tsv")).orderBy("seq").collect()] == [("a.com", "games"), ("b.com", "x\ty")]
    with tarfile.open(tmp_path / "u.tar.gz", "w:gz") as tar:
        for name, body in (("adult/domains", b"x.com\n*.y.com\n"), ("adult/urls", b"z.com/p\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    assert {r["domain"] for r in readers.archive_list(spark, str(tmp_path / "u.tar.gz")).collect()} == {"x.com", "y.com"}
    s = readers.settings({"artifactBaseUrl": "https://x/", "allowDomains": [" A.com ", ""], "syncHours": None})
    assert (s["artifactBaseUrl"], s["allowDomains"], s["syncHours"]) == ("https://x", ["a.com"], 12)


def test_remote_and_sync():
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return b"ok"

    assert remote.fetch("u", flaky, 0) == b"ok" and remote.fetch("u", lambda u: 1 / 0, 0) is None
    answers = iter([b'{"continue": {"c": "2"}, "n": 1}', b'{"n": 2}'])
    assert [a["n"] for a in remote.pages("b", {}, lambda u: next(answers))] == [1, 2]
    broken = iter([b'{"n": 1, "continue": {"c": "x"}}', *[None] * 9])
    with pytest.raises(OSError):
        list(remote.pages("b", {}, lambda u: next(broken)))
    local = sync.Local("v1", True, 0, {"0": "old", "9": "x"})
    assert sync.sync_state(local, {"version": "v1"}, 5) == "up-to-date"
    assert sync.sync_state(local, {"version": "v2"}, 5) == "throttled" and sync.sync_state(local, {"version": "v2"}, 5, force=True) == "update"
    assert sync.sync_state(sync.Local("v2", False, 0), {"version": "v2"}, 5) == "update"
    import hashlib

    sha = hashlib.sha256(b"body").hexdigest()
    done = []
    after = sync.apply_chunks(local, [{"file": "0", "sha256": sha}], lambda f: b"body", lambda f, b: done.append(f), lambda f: done.append("-" + f))
    assert done == ["0", "-9"] and after.chunks == {"0": sha}
    with pytest.raises(sync.Mismatch):
        sync.apply_chunks(local, [{"file": "0", "sha256": sha}, {"file": "1", "sha256": "no"}], lambda f: b"body", lambda f, b: done.append("bad"), lambda f: None)
    assert "bad" not in done and sync.current_no_pin([], ["b"], ["a"]) == ["a", "b"]
    assert set(sync.model_update(local, {"version": "m", "file": "w", "sha256": sha, "trees": {"file": "t", "sha256": "no"}}, lambda f: b"body")) == {"weights"}


def test_policy_rules():
    rules = lists.policy_rules(["a.com"], ["b.com", "c.com"])
    assert [(r["id"], r["priority"], r["action"]["type"]) for r in rules] == [(900_001, 100, "allow"), (950_001, 2, "block"), (950_002, 2, "block")]


def test_hex(spark):
    assert spark.range(1).select(hex64(F.lit(-1))).first()[0] == "f" * 16
