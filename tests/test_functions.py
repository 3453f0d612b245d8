import base64

import pytest
from pyspark.sql import functions as F

from sluice.functions import detect, html, text, urls


def one(spark, column, *values, schema=None):
    """`column` over rows of one value each."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema or "x string").select(column).collect()]


def test_normalize_domain(spark):
    lines = ["Example.COM", "0.0.0.0 ads.example.com # x", "*.a.example.org", "www.b.example.org.", "# note", "! note", "127.0.0.1 localhost", "1.2.3.4", "::1 six.example.net", "a..b", "com", "bücher.example", "", None, "-a.com", "x" * 64 + ".com"]
    want = ["example.com", "ads.example.com", "a.example.org", "b.example.org", None, None, None, None, "six.example.net", None, None, "xn--bcher-kva.example", None, None, None, None]
    assert one(spark, urls.normalize_domain("x", idn=True), *lines) == want


def test_suffixes(spark):
    assert one(spark, urls.domain_suffixes("x"), "a.B.example.com.", "localhost", "1.2.3.4", "", None) == [["a.b.example.com", "b.example.com", "example.com"], [], ["1.2.3.4"], [], []]
    assert one(spark, urls.ancestors("x"), "a.example.com", "example.com") == [["example.com"], []]


def test_registrable_domain(spark):
    hosts = ["a.b.example.co.uk", "example.com", "co.uk", "1.2.3.4", "x.y.kobe.jp", "city.kobe.jp", "me.github.io", "", None]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string")
    got = [r["etld1"] for r in urls.registrable_domain(rows, "host").orderBy("i").collect()]
    assert got == ["example.co.uk", "example.com", "", "", "x.y.kobe.jp", "city.kobe.jp", "github.io", "", ""]


def test_proxy_urls(spark):
    b64 = base64.b64encode(b"https://games.example.com/play/now").decode().rstrip("=")
    cases = {f"https://p.example/service/{b64}": True, "https://p.example/x/HTTPS%3A%2F%2Fa.example": True, "https://p.example/https://a.example": False, f"https://p.example/?u={b64}": False, "https://p.example/aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ": False, "not a url": False}
    assert one(spark, urls.looks_like_proxy_url("x"), *cases) == list(cases.values())


def test_search_pages(spark):
    cases = {"https://www.google.com/search": True, "https://www.google.com/searching": False, "https://google.com/": True, "https://google.com": True, "https://translate.google.com/": False, "https://duckduckgo.com/lite/x": True, "https://google.com/maps": False}
    assert one(spark, urls.is_search_url("x"), *cases) == list(cases.values())


def test_fnv(spark):
    assert one(spark, F.hex(text.fnv1a32("x")), "", "a", "foobar") == ["811C9DC5", "E40C292C", "BF9CF968"]
    assert one(spark, text.hex64(text.fnv1a64("x")), "", "foobar") == ["cbf29ce484222325", "85944171f73967e8"]


def test_terms(spark):
    assert sorted(one(spark, text.terms("x"), "Ab c")[0]) == sorted(["ab", "ab c", "#^ab", "#ab$", "#^ab$", "c", "#^c$"])


def test_softmax_and_time(spark):
    p = spark.range(1).select(text.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0]
    assert p == [0.5, 0.5]
    now = F.lit(10**12)
    assert one(spark, text.relative_time(F.col("x"), now), None, 10**12 - 59_999, 10**12 + 5, 10**12 - 61_000, 10**12 - 7_200_000, 10**12 - 3 * 86_400_000, schema="x long") == ["never", "just now", "just now", "1m ago", "2h ago", "3d ago"]


def test_glyph_cipher(spark):
    cases = {"plain words " * 20: False, "一丁丂七" * 50: True, "一" * 60: False, "абв " * 40: True, "абв " * 40 + "a": False, "": False}
    assert one(spark, detect.is_glyph_cipher(F.col("x"), F.lit("en")), *cases) == list(cases.values())
    assert one(spark, detect.is_glyph_cipher(F.col("x"), F.lit("ru")), "абв " * 40) == [False]


def test_svg(spark):
    cases = {"<svg><foreignObject></foreignObject></svg>": False, "<svg:foreignObject/><script>x</script>": True, "<foreignObject><script type='application/json'>": False, "<foreignObject><iframe src=x>": True, "<script>x</script>": False}
    assert one(spark, detect.is_svg_app(F.lit("main_frame"), F.lit("image/svg+xml"), F.col("x")), *cases) == list(cases.values())


PAGE = """<html><head><title>Play</title><meta name="description" content="fun"><meta property="og:title" content="og"><meta property="og:image" content="no"></head>
<body onclick="window.open('x')"><p>This paragraph has clearly more than forty characters in it.</p><p>short</p>
<a href="/in">in</a><a href="https://other.example.org/x">out</a><a href="/in">again</a>
<script src="https://cdn.exoclick.com/a.js"></script><script>window.open('y')</script>
<iframe src="https://frames.example.net/f" width="1000" height="600"></iframe><canvas width="1366" height="500"></canvas>
<form><input name="url" placeholder="address"><input type="password"><input name="card-number"></form><video></video>
You must be 18. Licensed by the gambling commission. Powered by Glype.</body></html>"""


def test_page_features():
    f = html.extract("https://site.example.com/a/b", PAGE)
    assert (f["title"], f["meta"], f["paragraph_count"], f["link_count"], f["outbound_domain_diversity"]) == ("Play", "fun og", 1, 3, 1)
    assert f["links"] == ["https://site.example.com/in", "https://other.example.org/x"]
    assert f["internal_link_ratio"] == pytest.approx(2 / 3)
    assert (f["fp_adult_adnet_count"], f["fp_proxy_marker_count"], f["popup_indicator_count"], f["password_field_count"]) == (1, 2, 2, 1)
    assert f["has_url_like_input"] and f["has_payment_field"] and f["has_age_gate"] and f["has_gambling_license_seal"] and f["has_video_player"]
    assert f["has_dominant_canvas"] and f["has_large_xorigin_iframe"] and f["iframe_cross_origin_count"] == 1
    assert f["third_party_script_ratio"] == 1.0 and f["inline_script_ratio"] == 0.5
    empty = html.extract(None, None)
    assert empty["text"] == "" and empty["dom_node_count"] == 0 and empty["link_density"] == 0.0


def test_areas_frames_and_depth():
    page = "<html><head><title>t</title><meta name=x></head><body><div><p>a<p>b</div><canvas width=600 height=500></canvas><canvas width=600 height=500></canvas><iframe src='https://cdn.site.com/x' width=1000 height=700></iframe></body></html>"
    f = html.extract("https://www.site.com/", page)
    assert f["canvas_area_fraction"] == 600 * 500 / html.VIEWPORT and not f["has_dominant_canvas"]
    assert (f["iframe_count"], f["iframe_cross_origin_count"], f["iframe_cross_origin"], f["has_large_xorigin_iframe"]) == (1, 0, False, False)
    assert f["max_dom_depth"] == 3  # body, div, p
    assert html.extract("https://www.site.com/", "<div><p>x</p></div>")["max_dom_depth"] == 3
    other = html.extract("https://www.site.com/", page.replace("cdn.site.com", "cdn.other.com"))
    assert other["iframe_cross_origin"] and other["has_large_xorigin_iframe"]


def test_public_suffixes_come_with_the_package():
    plain, wild, exceptions = urls.public_suffixes()
    assert {"com", "co.uk", "xn--p1ai"} <= set(plain) and "ck" in wild and "www.ck" in exceptions and len(plain) > 5000


def test_words_of_whole_texts(spark):
    import random
    import re

    rng = random.Random(3)
    texts = [None, "", " ", "a", "Été 12ab\x00c", "x" * 5000, " ".join(rng.choice(["alpha", "Beta9", "ü", "--", "z"]) for _ in range(70_000)), "KK İ end", "end"]
    rows = list(enumerate(texts)) + [(1, "twice"), (1, "twice"), (None, "word word")]

    def fnv(data, h=2166136261):
        for b in data:
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    def simhash(t):
        found = re.findall("[a-z0-9]+", spark_lower(t))
        hashes = [(fnv(w.encode()) << 32) | fnv(w[::-1].encode()) for w in found]
        return sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)

    df = spark.createDataFrame(rows, "id long, text string")
    lowered = {r["text"]: r["low"] for r in df.selectExpr("text", "lower(text) as low").collect()}
    spark_lower = lambda t: lowered[t] or ""
    got = sorted((r["id"] is None, r["id"] or 0, r["simhash"] & (2**64 - 1)) for r in text.simhash(df, "id", "text").collect())
    assert got == sorted((i is None, i or 0, simhash(t)) for i, t in rows)
    assert text.simhash(df.limit(0), "id", "text").collect() == [] == text.term_vector(df.limit(0), "id", "text").collect()
    sums = {r["id"]: r["s"] for r in text.term_vector(df.where("id > 2 and id <> 1"), "id", "text").groupBy("id").agg(F.sum(F.col("value") ** 2).alias("s")).collect()}
    assert set(sums) == {3, 4, 5, 6, 7, 8} and all(abs(s - 1) < 1e-9 for s in sums.values())


def test_near_pairs_as_by_brute_force(monkeypatch):
    import numpy as np

    from sluice.functions import near

    monkeypatch.setattr(near, "AT_ONCE", 50)
    rng = np.random.default_rng(1)
    for centres, n in ((2, 150), (30, 200), (1, 0)):
        base = rng.integers(0, 2**64, centres, np.uint64)
        x, y = (rng.choice(base, n) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 4)).astype(np.uint64), axis=1) for _ in range(2))
        want = np.bitwise_count(x[:, None] ^ y[None, :]) <= 4
        got = [p for i, j in near.pairs(x, y, 4) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
        assert near.covered(x, y, 4).tolist() == want.any(axis=1).tolist()
        masks = near.layout(y)
        assert sum(m.item().bit_count() for m in masks) == 64 and int(np.bitwise_or.reduce(masks)) == 2**64 - 1


def test_pages_of_one_row_group_are_dealt_out(spark, tmp_path):
    from sluice.plans.session import spread

    rows = spark.range(200).selectExpr("id as page_id", "'https://site.example.com/' as url", "concat('<p>', id) as html")
    rows.coalesce(1).write.parquet(str(tmp_path / "pages"))
    one = spark.read.parquet(str(tmp_path / "pages"))
    found = html.page_features(one).select("page_id", "text", F.spark_partition_id().alias("task")).collect()
    assert {(r["page_id"], r["text"]) for r in found} == {(i, str(i)) for i in range(200)} and len(found) == 200
    assert len({r["task"] for r in found}) >= spark.sparkContext.defaultParallelism
    shuffled = one.repartition(2, "page_id")
    assert spread(shuffled) is shuffled


def test_seals_and_gates_as_by_the_patterns():
    cases = ["Licensed by x", "LICENSED AND REGULATED", "l\u0131censed by", "L\u0130CENSED BY", "licen\u017fed by", "mga/", "CURA\u00c7AO", "Malta  Gaming", "gaming  licen\u017fe", "must be 18", "mu\u017ft be 21", "AGE GATE", "age-ver\u0131fication", "adults only", "gate", "licensed", "curate"]
    for t in cases:
        f = html.extract("https://a.example.com/", f"<p>{t}</p>")
        assert (f["has_gambling_license_seal"], f["has_age_gate"]) == (bool(html.LICENSE_SEAL.search(" ".join(t.split()))), bool(html.AGE_GATE.search(t))), t


def test_a_slice_of_pages_at_a_time(monkeypatch):
    import pyarrow as pa

    done, plain = [], html.extract
    monkeypatch.setattr(html, "extract", lambda u, h: done.append(u) or plain(u, h))
    pages = [None, "", "<p>x</p>" * 10, *["<a href='/b'>" + "y" * 50_000 + "</a>"] * 40, "z" * 900_000, None, "<i>end</i>"]
    batch = pa.record_batch([pa.array(range(len(pages))), pa.array([None, *["https://a.example.com/"] * (len(pages) - 1)]), pa.array(pages, pa.string())], ["k", "url", "html"])
    out, held = [], 0
    for b in html.features_of_batches(iter([batch.slice(0, 0), batch.slice(1), batch.slice(0, 1)])):
        held = max(held, len(done) - len(out))
        out += b.to_pylist()
    assert held < 10 and [r["k"] for r in out] == [*range(1, len(pages)), 0]
    assert all({n: r[n] for n in want} == want for r in out for want in [plain(r["url"], pages[r["k"]])])
