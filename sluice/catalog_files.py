"""Queries that write files or streams and read them back, records, models and decisions, over the driver's tables, with their DuckDB twins.

Files go to a new folder in that of spark.checkpoint.dir.
"""

from __future__ import annotations

import io
import tarfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.catalog import _CLASSES, _FIRST, _LOOKUP, _P, _PAGES, _Q, _RESCUE, EVENTS_DUCK, HOST, NAVIGATED, RANKED, TRUTH, _structured, _top, events, fnv32, listed, query, standin, table
from sluice.functions import text
from sluice.functions.html import page_features
from sluice.operators import corpus, lists, metrics, records, scoring
from sluice.operators.rank import numbered
from sluice.plans import policy
from sluice.plans.session import shared_folder, spread
from sluice.sources import readers, writers
from sluice.streaming import state

# ---- readers -------------------------------------------------------------------


def _lines(df: DataFrame, order: str = "k") -> str:
    """The path of a text of the column value, in order of another, in one file: a fixture."""
    path = shared_folder(df.sparkSession)
    df.orderBy(order).coalesce(1).select("value").write.text(path)
    return path


@query("select concat(case when n_nationkey % 2 = 0 then 'a' else 'b' end, n_nationkey, '.example.com') as domain from nation")
def read_domain_list(spark, d):
    n = table(spark, d, "nation").selectExpr("n_nationkey as k", "concat(case n_nationkey % 3 when 0 then '0.0.0.0 ' when 1 then '' else '*.' end, case when n_nationkey % 2 = 0 then 'A' else 'b' end, n_nationkey, '.example.com', case when n_nationkey % 5 = 0 then ' # note' else '' end) as value")
    notes = spark.createDataFrame([(100, "# note"), (101, ""), (102, "localhost"), (103, "1.2.3.4")], "k long, value string")
    return readers.domain_list(spark, _lines(n.selectExpr("cast(k as long) as k", "value").union(notes))).select("domain")


@query("select 'n' || n_nationkey || '.example.com' as domain from nation")
def read_archive_list(spark, d):
    body = "\n".join(f"n{r[0]}.example.com" for r in table(spark, d, "nation").select("n_nationkey").collect()).encode()  # 25 rows
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in (("blacklists/games/domains", body), ("blacklists/games/urls", b"x.example.com/a"), ("blacklists/README", b"y.example.com")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    path = f"{shared_folder(spark)}/list.tar.gz"
    writers.write_text(spark, path, out.getvalue())
    return readers.archive_list(spark, path).select("domain")


@query("select domain, max(i) as rank from (select 'd' || (p_partkey % 131) || '.example.com' as domain, row_number() over (order by p_partkey) as i from part where p_partkey % 7 <> 0) group by 1")
def read_ordinal_ranks(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey as k", "case when p_partkey % 7 = 0 then 'no domain' else concat(p_partkey * 3, ', D', p_partkey % 131, '.example.com ') end as value")
    return readers.ordinal_ranks(spark, _lines(p)).select("domain", F.col("rank").cast("long").alias("rank"))


@query("select 'd' || (p_partkey % 131) as domain, arg_max(p_partkey * 3, p_partkey) as rank from part where p_partkey % 5 <> 0 group by 1")
def read_numbered_ranks(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey as k", "concat(case when p_partkey % 5 = 0 then 'x' else cast(p_partkey * 3 as string) end, ',d', p_partkey % 131) as value")
    return readers.numbered_ranks(spark, _lines(p))


@query("select 'supplier' || s_suppkey || '.net' as host from supplier where s_suppkey % 4 <> 0")
def read_commented_list(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey as k", "case when s_suppkey % 4 = 0 then ' # nothing' else concat(' Supplier', s_suppkey, '.NET #', s_suppkey) end as value")
    return readers.commented_list(spark, _lines(s)).select("host")


@query("select 'S' || s_suppkey || ' # kept' as seed from supplier where s_suppkey % 4 > 1")
def read_seed_list(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey as k", "case s_suppkey % 4 when 0 then '# note' when 1 then '  ' else concat(' S', s_suppkey, ' # kept') end as value")
    return readers.seed_list(spark, _lines(s)).select("seed")


@query("select distinct 't' || (s_suppkey % 10) as token from supplier")
def read_attempts(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey as k", "concat('t', s_suppkey % 10, case when s_suppkey % 3 = 0 then '  \t' else ' ' end, 't', (s_suppkey + 1) % 10, ' ') as value")
    return readers.tokens(spark, _lines(s)).unionByName(readers.tokens(spark, shared_folder(spark)))  # the second log is missing


@query("select 's' || s_suppkey as domain, 'a' || chr(9) || s_suppkey as label from supplier where s_suppkey % 3 <> 0")
def read_labelled_domains(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey as k", "concat('s', s_suppkey, case when s_suppkey % 3 = 0 then ' a' else '\ta\t' end, s_suppkey) as value")
    return readers.labelled_domains(spark, _lines(s)).select("domain", "label")


@query("select 'https://u' || s_suppkey || '.example.com/' as url, 'games' as label from supplier where s_suppkey % 3 <> 0")
def read_labelled_urls(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey as k", "case when s_suppkey % 3 = 0 then ' ' else concat(' https://u', s_suppkey, '.example.com/ ') end as value")
    return readers.labelled_urls(spark, _lines(s), "games").select("url", "label")


@query("select 'u' || s_suppkey as url, s_suppkey::bigint as n, 'a' || chr(8232) || s_suppkey as text from supplier where s_suppkey % 4 > 1")
def read_json_tolerant(spark, d):
    # a Unicode line separator inside a text ends no line
    whole = F.to_json(F.struct(F.concat(F.lit("u"), "s_suppkey").alias("url"), F.col("s_suppkey").alias("n"), F.concat(F.lit("a\u2028"), "s_suppkey").alias("text")))
    value = F.when(F.col("s_suppkey") % 4 == 0, "").when(F.col("s_suppkey") % 4 == 1, '{"url": "broken').otherwise(whole)
    return readers.json_records(spark, _lines(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), value.alias("value"))), "url string, n long, text string")


@query("select 'u' || s_suppkey as url, s_suppkey::bigint as n, 0 as origin from supplier union all select 'v' || n_nationkey, n_nationkey::bigint, 1 from nation")
def read_json_union(spark, d):
    a = table(spark, d, "supplier").selectExpr("s_suppkey as k", "to_json(named_struct('url', concat('u', s_suppkey), 'n', s_suppkey)) as value")
    b = table(spark, d, "nation").selectExpr("n_nationkey as k", "to_json(named_struct('url', concat('v', n_nationkey), 'n', n_nationkey)) as value")
    return readers.json_union(spark, "url string, n long", f"{_lines(a)}/*.txt", f"{_lines(b)}/*.txt").select("url", "n", "origin")


# ---- writers -------------------------------------------------------------------


@query(f"with {_FIRST} select domain, 'c' || cat as label from first union all (select domain, 'clean' from ({RANKED}) where domain not in (select domain from first) order by rank, domain limit 40)")
def write_labels(spark, d):
    path = shared_folder(spark)
    writers.labels(lists.label_rows(lists.first_wins(listed(spark, d)), standin(spark, d, RANKED), {i: f"c{i}" for i in range(5)}, 40), path)
    return readers.labelled_domains(spark, path).select("domain", "label")


@query("select doc_id, text from documents where doc_id % 3 = 1")
def write_splits(spark, d):
    path = shared_folder(spark)
    writers.splits(table(spark, d, "documents").select("doc_id", "text", F.expr("case doc_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end").alias("split")), path)
    return readers.json_records(spark, f"{path}/split=val", "doc_id long, text string", strict=True)


@query("select 'kept' as part, count(*) as n, sum(doc_id)::bigint as s from documents where doc_id % 5 <> 0 union all select 'quarantined', count(*), sum(doc_id)::bigint from documents where doc_id % 5 = 0")
def write_quarantine(spark, d):
    path = shared_folder(spark)
    writers.quarantine(table(spark, d, "documents").select("doc_id", F.expr("case when doc_id % 5 = 0 then 'games' end").alias("contamination")), path)
    part = lambda p: readers.json_records(spark, f"{path}/{p}", "doc_id long", strict=True).agg(F.lit(p).alias("part"), F.count("*").alias("n"), F.sum("doc_id").alias("s"))
    return part("kept").unionByName(part("quarantined"))


_TIER = f"with recursive {_FIRST}, tier as (select domain, row_number() over (order by cat, src, seq, domain) - 1 as pos from first)"


@query(f"{_TIER} select lpad((pos // 20)::varchar, 3, '0') || '.json' as file, (pos // 20) * 4 + 1 as first_id, count(*) as domains, ceil(count(*) / 5.0)::bigint as rules from tier where pos < 140 group by pos // 20")
def write_rule_chunks(spark, d):
    tier = numbered(lists.first_wins(listed(spark, d)), *map(F.col, ("cat", "src", "seq", "domain")), name="pos").select("domain", "pos")
    path = shared_folder(spark)
    writers.rule_chunks(spark, lists.rule_bodies(lists.pack_rules(tier, domains_per_rule=5, rules_per_chunk=4, max_rules=28)), path)
    rules = spark.read.schema("id long, condition struct<requestDomains: array<string>>").json(f"{path}/*.json").select("id", F.size("condition.requestDomains").alias("n"), F.regexp_extract(F.col("_metadata.file_path"), r"(\d+\.json)$", 1).alias("file"))
    return rules.groupBy("file").agg(F.min("id").alias("first_id"), F.sum("n").alias("domains"), F.count("*").alias("rules"))


@query(f"with {_FIRST} select count(*) as n, sum(cat)::bigint as cats, true as ascending from first")
def write_tail(spark, d):
    path = shared_folder(spark)
    writers.tail(lists.tail_table(lists.first_wins(listed(spark, d))), path)
    h, c = writers.tail_binary(spark.read.parquet(path))
    order = np.frombuffer(h, "<u8")
    return spark.createDataFrame([(len(order), int(np.frombuffer(c, np.uint8).sum()), bool((order[1:] > order[:-1]).all()))], "n long, cats long, ascending boolean")


@query(f"with {_FIRST} select 'v2' as version, count(*) as domains, 1 as generation from first")
def published_manifest(spark, d):
    first = lists.first_wins(listed(spark, d))
    tail = lists.tail_table(first)
    root, meta = shared_folder(spark), {"domains": first.count(), "content": writers.content_version(tail, ["a"], [])}
    for version in ("v1", "v2"):
        writers.commit(spark, root, version, meta)
    found = readers.manifest(spark, readers.current(spark, root))
    same = int(found["content"] == writers.content_version(tail.repartition(3), ["a"], []))
    return spark.createDataFrame([(found["version"], found["domains"], same)], "version string, domains long, generation int")


@query("select c_custkey::bigint as k, c_name as name from customer where c_custkey % 2 = 0 union all select c_custkey::bigint, c_name from customer where c_custkey % 2 = 0 and c_custkey % 3 = 0")
def append_to_log(spark, d):
    path, c = shared_folder(spark), table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("cast(c_custkey as long) as k", "c_name as name")
    writers.append_log(c, path)
    writers.append_log(c.where("k % 3 = 0"), path)
    return readers.json_records(spark, path, "k long, name string", strict=True)


@query(f"select 'category' as section, category as key, count(*) as n from ({EVENTS_DUCK}) group by all union all select 'source', source, count(*) from ({EVENTS_DUCK}) group by all union all select 'domain', domain, count(*) from ({EVENTS_DUCK}) group by all")
def report_as_csv(spark, d):
    path = shared_folder(spark)
    writers.report_csv(events(spark, d), path)
    part = lambda by: spark.read.option("header", True).option("escape", '"').csv(f"{path}/{by}").select(F.lit(by).alias("section"), "key", F.col("n").cast("long").alias("n"))
    return part("category").unionByName(part("source")).unionByName(part("domain"))


@query(f"select count(*) as total, count(*) filter (source = 'list') as from_lists, 50 as recent, '2026-01-01' as exported from ({EVENTS_DUCK})")
def report_as_json(spark, d):
    made = writers.report_json(events(spark, d), "2026-01-01").select(F.from_json("json", "exported string, stats struct<total: long, bySource: map<string, long>>, recentEvents array<struct<t: long>>").alias("j"))
    return made.select("j.stats.total", F.col("j.stats.bySource")["list"].alias("from_lists"), F.size("j.recentEvents").alias("recent"), "j.exported")


# ---- texts and records ---------------------------------------------------------


@query("select doc_id, coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(text, '') as whole from documents")
def whole_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.whole_document(F.col("source"), F.col("lang"), F.col("text")).alias("whole"))


@query("select doc_id, 'a   b ' || doc_id || ' \"   \"' as body from documents")
def data_uris(spark, d):
    return table(spark, d, "documents").select("doc_id", text.without_data_uris(F.expr("concat('a ', case when doc_id % 2 = 0 then 'data:image/png;base64,iVBOR' else 'DATA:x' end, ' b ', doc_id, ' \" data:text/html,x,y \"')")).alias("body"))


@query(
    "select doc_id, case doc_id % 4 when 0 then 0.5 when 1 then 0.0 when 2 then 0.0 else 2.0 end::double as link_density, case doc_id % 4 when 0 then 3 when 3 then 7 else 0 end as link_count, "
    "doc_id % 4 in (0, 3) as has_age_gate, false as has_payment_field, 0 as tag_div, case when doc_id % 2 = 0 then 1 else 0 end as hosts from documents"
)
def typed_structures(spark, d):
    raw = F.expr("map('link_density', case doc_id % 4 when 0 then '0.5' when 1 then 'junk' when 2 then 'NaN' else '2' end, 'link_count', case doc_id % 4 when 0 then '3' when 1 then 'x' when 2 then null else '7' end, 'has_age_gate', case doc_id % 4 when 0 then 'true' when 1 then 'false' when 2 then 'junk' else '1' end)")
    rows = table(spark, d, "documents").withColumn("raw", raw).withColumn("hosts", F.expr("case when doc_id % 2 = 0 then array('a.com') end"))
    s = records.typed_structure(lambda n: F.element_at("raw", n), ("link_count", "tag_div"), F.col("hosts"))
    return rows.withColumn("s", s).select("doc_id", "s.link_density", "s.link_count", "s.has_age_gate", "s.has_payment_field", "s.tag_div", F.size("s.script_hosts").alias("hosts"))


@query(
    f"select page_id, array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') as etld1, url, case when page_id % 2 = 0 then 'clean' else 'games' end as label, length(url)::int as url_length, "
    "regexp_extract_all(html, '<[a-zA-Z]').len() as dom_node_count, regexp_extract_all(lower(html), '<object[\\s>/]').len() as tag_object, false as url_embeds_url, (lower(url) like '%game%')::int + (lower(url) like '%play%')::int + (lower(url) like '%unblocked%')::int + (lower(url) like '%io%')::int + (lower(url) like '%arcade%')::int + (lower(url) like '%html5%')::int as kw_url_games, 61 as fields from pages"
)
def built_records(spark, d):
    made = records.build_records(table(spark, d, "pages"), F.expr("case when page_id % 2 = 0 then 'clean' else 'games' end"))
    s = made.schema["structural"].dataType
    return made.select("page_id", "etld1", "url", "label", "structural.url_length", "structural.dom_node_count", "structural.tag_object", "structural.url_embeds_url", "structural.kw_url_games", F.lit(len(s.fields) - 1).alias("fields"))


_RECORDS = "select lang as label, concat('https://', source, '.example.com/', cast(doc_id % 50 as string), '/') as url, '' as title, '' as meta, text, doc_id from documents"


@query(f"select label, count(*) as kept from ({_RECORDS}) where length(regexp_replace(text, '\\s+', '', 'g')) >= 80 and not regexp_matches(lower(text), '" + "|".join(p.replace("'", "''") for p in corpus.PARKED + corpus.CHALLENGE + corpus.REMOVED) + "') group by label")
def progress_by_label(spark, d):
    return records.kept_by_label(standin(spark, d, _RECORDS))


@query(f"select distinct regexp_replace(replace(url, 'https://', ''), '/+$', '') as domain from ({_RECORDS})")
def domains_in_corpus(spark, d):
    return records.kept_domains(standin(spark, d, _RECORDS))


@query(
    "with p as (select 'L' || (s_suppkey % 3) as label, 'd' || s_suppkey as domain, s_suppkey::bigint as pos from supplier), open as (select distinct label from p where label <> 'L0'), "
    "r as (select p.*, row_number() over (partition by label order by pos) as n from p join open using (label) where pos % 4 <> 0 and pos % 5 <> 0) select label, domain, pos from r where n <= 6"
)
def next_in_frontier(spark, d):
    pool = table(spark, d, "supplier").selectExpr("concat('L', s_suppkey % 3) as label", "concat('d', s_suppkey) as domain", "cast(s_suppkey as long) as pos")
    kept = table(spark, d, "supplier").where("s_suppkey % 5 = 0").selectExpr("'L0' as label", "concat('https://d', s_suppkey, '/') as url", "'' as title", "'' as meta", "repeat('words ', 40) as text")
    return records.next_attempts(pool, pool.where("pos % 4 = 0"), kept, 1, 6)


@query("select 0::bigint as shared")
def splits_disjoint(spark, d):
    split = corpus.split_by_key(table(spark, d, "documents").select("doc_id", "source"), "source", (0.8, 0.1, 0.1))
    return split.groupBy("source").agg(F.countDistinct("split").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("shared"))


@query(
    f"with l as (select l_orderkey as page_id, 'https://s' || (l_suppkey % 3) || '.example.com/p/' || (l_partkey % 40) as link, l_suppkey % 3 as ls, l_orderkey % 3 as ps, l_linenumber as seq from lineitem), "
    f"o as (select page_id, link, min(seq) as seq from l where ls = ps group by all) select page_id, link from o qualify row_number() over (partition by page_id order by {fnv32(chr(39) + '0|' + chr(39) + ' || link')}, link) <= 1"
)
def sampled_interior_links(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as page_id", "concat('https://s', l_suppkey % 3, '.example.com/p/', l_partkey % 40) as link", "concat('s', l_suppkey % 3) as link_site", "concat('s', l_orderkey % 3) as page_site", "l_linenumber as seq")
    return corpus.interior_links(rows, 1).select("page_id", "link")


@query("select p_name as provider, 'alpha' || p_partkey || '.com' as domain from (select 'Alpha' || p_partkey as p_name, p_partkey from part)")
def provider_anchors(spark, d):
    p = table(spark, d, "part").selectExpr("concat('Alpha', p_partkey) as provider", "p_partkey")
    found = p.select("provider", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.expr(e).alias("etld1")) for i, e in enumerate(("'github.io'", "'other.com'", "concat('alpha', p_partkey, '.com')", "'cheap.lol'"))])).alias("c")).select("provider", "c.etld1", "c.seq")
    return corpus.pick_anchor(found)


@query(f"select strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day, count(*) as total from ({EVENTS_DUCK}) group by 1")
def totals_of_days(spark, d):
    day = F.date_format(F.expr("timestampadd(MILLISECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "yyyy-MM-dd")
    counts = events(spark, d).groupBy(day.alias("day"), "category").agg(F.count("*").alias("n"))
    maps = counts.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))
    return maps.select("day", text.map_total(F.col("m")).alias("total"))


# ---- pages made to show every feature ------------------------------------------

_MADE = (
    "select c_custkey as page_id, 'https://www.site.com/a' as url, concat('<!DOCTYPE html><html><head><title>T', c_custkey, '</title><meta name=\"description\" content=\"M', c_custkey, '\"><meta property=\"og:title\" content=\"O\"><meta property=\"og:image\" content=\"no\"></head><body><div>', "
    "repeat('<p>a paragraph that is longer than forty characters, surely</p>', cast(c_custkey % 4 as int)), case when c_custkey % 5 = 0 then '<canvas width=\"1000\" height=\"700\"></canvas><canvas width=\"300\" height=\"200\"></canvas>' else '' end, "
    "case c_custkey % 7 when 1 then '<iframe src=\"https://cdn.site.com/x\" width=\"900\" height=\"700\"></iframe>' when 2 then '<iframe src=\"https://other.net/x\" width=\"900\" height=\"700\"></iframe>' else '' end, "
    "repeat('<script src=\"https://s1.cdn.net/x.js\"></script>', cast(c_custkey % 3 as int)), case when c_custkey % 2 = 0 then '<script src=\"https://www.exoclick.com/a.js\"></script>' else '<script>window.open(1)</script>' end, "
    "case when c_custkey % 11 = 0 then '<input name=\"url\">' else '<input type=\"search\" name=\"url\">' end, case when c_custkey % 13 = 0 then '<form><input type=\"password\"></form>' else '' end, case when c_custkey % 17 = 0 then '<input autocomplete=\"cc-number\">' else '' end, "
    "case when c_custkey % 19 = 0 then '<b>You must be 18</b>' else '' end, case when c_custkey % 23 = 0 then '<video></video>' else '' end, case when c_custkey % 29 = 0 then '<i>licensed by the state</i>' else '' end, "
    "'<a href=\"/in\">in</a><a href=\"https://other.org/\">out</a><a href=\"/in\">again</a></div></body></html>') as html from customer"
)


@query(
    "with k as (select c_custkey as page_id, c_custkey as k, c_custkey % 3 as cdn, c_custkey % 2 = 0 as even from customer) select page_id, 'T' || k as title, 'M' || k || ' O' as meta, 3 as link_count, 2 as n_links, round(2 / 3.0, 9)::double as internal_link_ratio, 1 as outbound_domain_diversity, "
    "(k % 4)::int as paragraph_count, 3::int + (0 * k)::int as max_dom_depth, case when k % 5 = 0 then round(700000 / 1049088.0, 9) else 0 end::double as canvas_area_fraction, k % 5 = 0 as has_dominant_canvas, (k % 7 = 2)::int as iframe_cross_origin_count, k % 7 = 2 as has_large_xorigin_iframe, "
    "round(case when k % 7 in (1, 2) then 630000 / 1049088.0 else 0 end, 9)::double as largest_iframe_area_fraction, round(case when even then 1.0 when cdn > 0 then 1.0 else 0.0 end, 9)::double as third_party_script_ratio, round(case when even then 0 else 1 / (cdn + 1.0) end, 9)::double as inline_script_ratio, "
    "round(case when even and cdn = 1 then 1.0 when even and cdn = 2 then -(log2(1 / 3.0) / 3 + log2(2 / 3.0) * 2 / 3) else 0 end, 9)::double as script_host_entropy, (case when even then 1 else 0 end)::int as fp_adult_adnet_count, (case when even then 0 else 1 end)::int as popup_indicator_count, "
    "k % 11 = 0 as has_url_like_input, (k % 13 = 0)::int as password_field_count, (k % 13 = 0)::int as form_count, k % 17 = 0 as has_payment_field, k % 19 = 0 as has_age_gate, k % 23 = 0 as has_video_player, k % 29 = 0 as has_gambling_license_seal from k where k % 13 <> 0"
)
def features_of_made_pages(spark, d):
    customers = spread(table(spark, d, "customer").select("c_custkey"))  # a page is longer than its key
    f = page_features(spark.sql(_MADE.replace(" from customer", " from {__t}"), __t=customers)).where("page_id % 13 <> 0")  # a form is one level deeper
    ratio = ["internal_link_ratio", "canvas_area_fraction", "largest_iframe_area_fraction", "third_party_script_ratio", "inline_script_ratio", "script_host_entropy"]
    plain = ["title", "meta", "link_count", "outbound_domain_diversity", "paragraph_count", "max_dom_depth", "has_dominant_canvas", "iframe_cross_origin_count", "has_large_xorigin_iframe", "fp_adult_adnet_count", "popup_indicator_count", "has_url_like_input", "password_field_count", "form_count", "has_payment_field", "has_age_gate", "has_video_player", "has_gambling_license_seal"]
    return f.select("page_id", *plain, F.size("links").alias("n_links"), *[F.round(c, 9).alias(c) for c in ratio])


# ---- models and decisions ------------------------------------------------------

@query(
    "with z as (select doc_id, 0.25 + case when doc_id % 7 <= 3 then 1.5 else -0.5 end as a, -0.25 + case when doc_id % 5 <= 1 then case when doc_id % 7 <= 5 then 2.0 else 0.5 end else -1.0 end as b from documents) "
    "select doc_id, round(exp(a) / (exp(a) + exp(b)), 9)::double as p0, round(exp(b) / (exp(a) + exp(b)), 9)::double as p1 from z"
)
def tree_scores(spark, d):
    one = [(0, 3.0, 1, 2, 0.0, False, True), (0, 0.0, 0, 0, 1.5, True, False), (0, 0.0, 0, 0, -0.5, True, False)]
    two = [(1, 1.0, 1, 4, 0.0, False, True), (0, 5.0, 2, 3, 0.0, False, True), (0, 0.0, 0, 0, 2.0, True, False), (0, 0.0, 0, 0, 0.5, True, False), (0, 0.0, 0, 0, -1.0, True, False)]
    made = scoring.Trees(["a", "b"], [0.25, -0.25], [[one, two]])
    loaded = scoring.Trees.load(made.exported(np.array([[x, y] for x in range(7) for y in range(5)], np.float64)))
    scored = scoring.score_trees(table(spark, d, "documents").select("doc_id"), loaded, [F.col("doc_id") % 7, F.col("doc_id") % 5])
    return scored.select("doc_id", F.round(F.col("scores")[0], 9).alias("p0"), F.round(F.col("scores")[1], 9).alias("p1"))


@query(
    "with w as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from benchmark), p as (select item_id, ws, unnest(range(1, len(ws) + 1)) as i from w), "
    "t as (select item_id, ws[i] as term from p union all select item_id, ws[i] || ' ' || ws[i + 1] from p where i < len(ws) "
    "union all select item_id, '#' || substr('^' || ws[i] || '$', j, k) from p, unnest(range(1, 300)) as a(j), unnest([3, 4]) as b(k) where j + k - 1 <= length(ws[i]) + 2), "
    f"h as (select item_id, {fnv32('term')} as h from t), a as (select item_id, h & 65535 as idx, sum(case when (h >> 31) & 1 = 1 then -1 else 1 end)::double as x from h group by all), "
    "n as (select item_id, sqrt(sum(x * x)) as norm from a group by 1), z as (select item_id, 0.5 + sum(x / norm * (idx % 3 - 1)) as a, sum(x / norm * (idx % 5 - 2)) as b from a join n using (item_id) where norm > 0 group by 1) "
    "select item_id, round(exp(a) / (exp(a) + exp(b)), 6) as p_games from z"
)
def text_scores(spark, d):
    idx = np.arange(text.DIMS)
    data, meta = scoring.TextModel(["games", "clean"], np.stack([idx % 3 - 1, idx % 5 - 2]).astype(np.float32), np.array([0.5, 0.0])).save()
    scored = scoring.score_text(table(spark, d, "benchmark"), scoring.TextModel.load(data, meta), "item_id", "text")
    return scored.where("class = 'games'").select("item_id", F.round("score", 6).alias("p_games"))


@query("""select left(sha256(unhex('0000000000000007') || 'weights'::blob || unhex('0000000000000015') || '{"a":[1.5,"x"],"b":1}'::blob || unhex('0000000000000005') || 'trees'::blob), 16) as id""")
def model_content_id(spark, d):
    return spark.createDataFrame([(scoring.content_id(b"weights", {"b": 1, "a": [1.5, "x"], "version": "none"}, b"trees"),)], "id string")


@query(
    f"select doc_id, case when fp >= 0.6 then fc when tp >= 0.89 and not rescued then tc end as category, case when fp >= 0.6 then fp when tp >= 0.89 and not rescued then tp end as confidence, case when tp >= 0.8 then tc end as text_alone "
    f"from (select *, {_RESCUE.replace('cat ', 'tc ')} as rescued from (select *, {_top(_Q)[0]} as fc, {_top(_Q)[1]} as fp, {_top(_P)[0]} as tc, {_top(_P)[1]} as tp from {_PAGES}))"
)
def decisions_under_policy(spark, d):
    s = _structured(spark, d)
    p, q = (F.array(*[F.expr(x) for x in xs]) for xs in (_P, _Q))
    rows = s.withColumn("v", scoring.decide_with_policy(p, q, F.col("s"), _CLASSES, 0.6)).withColumn("a", scoring.decide_with_policy(p, None, F.col("s"), _CLASSES))
    return rows.select("doc_id", "v.category", "v.confidence", F.col("a.category").alias("text_alone"))


@query(f"select doc_id, case when doc_id % 4 <> 0 and confidence >= 0.5 then y_pred else 'clean' end as found from ({TRUTH})")
def evaluated_text(spark, d):
    url = F.expr("case when doc_id % 4 = 0 then 'https://www.google.com/search?q=x' else 'https://a.example.com/' end")
    return standin(spark, d, TRUTH).select("doc_id", scoring.evaluate_text(F.col("y_pred"), F.col("confidence"), url, 0.5).alias("found"))


@query(
    _LOOKUP + ", v as (select nav, n.host, matched, host like 'x.s1.%' as pinned from (select * from (" + NAVIGATED + ")) n left join hit using (host)) "
    "select nav, host, case when pinned and not (host like '%.d7.example.com') then 'model' when matched is not null then 'list' end as source from v"
)
def navigation_with_pins(spark, d):
    n = standin(spark, d, NAVIGATED).withColumn("url", F.concat(F.lit("https://"), F.col("host"), F.lit("/page"))).withColumn("frame", F.lit(0))
    pins = n.where("host like 'x.s1.%'").select("host", F.lit("games").alias("category")).distinct()
    none = spark.createDataFrame([], "domain string")
    never = spark.createDataFrame([("d7.example.com",)], "host string")
    tail = lists.tail_table(lists.first_wins(listed(spark, d)))
    return policy.navigation_verdicts(n.drop("host"), tail, none, none, pins, never).select("nav", "host", "source")


_SCAN = "case when host = 'd5.example.com' or host like '%.d5.example.com' then null when nav % 5 = 0 then 'proxy-bypass' when nav % 3 = 0 then 'games' end"


@query(f"select nav, {_SCAN} as category, case when ({_SCAN}) is null then 'allow' else 'block' end as action, coalesce(({_SCAN}) = 'games' and nav % 2 = 0 and nav % 7 <> 0, false) as pin from ({NAVIGATED})")
def scan_decisions(spark, d):
    rows = standin(spark, d, NAVIGATED).selectExpr("nav", "concat('https://', host, '/') as url", "cast(null as string) as real_host", "cast(nav % 7 = 0 as int) as frame", "case when nav % 5 = 0 then repeat('一丁丂七', 50) else 'plain words' end as text", "'en' as lang", "named_struct('has_dominant_canvas', nav % 2 = 0, " + ", ".join(f"'{n}', false" for n in ("url_embeds_url", "has_url_like_input", "has_video_player", "has_age_gate", "has_large_xorigin_iframe", "has_gambling_license_seal", "has_payment_field")) + ", 'fp_proxy_marker_count', 0, 'paragraph_count', 9) as structural")
    decision = F.expr("case when nav % 3 = 0 then named_struct('category', 'games', 'confidence', 0.9D) end")
    return policy.scan_verdicts(rows, spark.createDataFrame([("d5.example.com",)], "domain string"), decision).select("nav", "category", "action", "pin")


@query(_LOOKUP + f" select nav, case when host = 'd6.example.com' or host like '%.d6.example.com' then 'district-policy' else coalesce(cat::varchar, 'uncategorized') end as category from ({NAVIGATED}) n left join hit using (host) where nav % 3 = 0 and nav % 4 <> 1")
def blocked_by_network(spark, d):
    rows = standin(spark, d, NAVIGATED).selectExpr("nav", "concat('https://', host, '/') as url", "case when nav % 4 = 1 then 1 else 0 end as frame", "case when nav % 3 = 0 then 'net::ERR_BLOCKED_BY_CLIENT' else 'net::ERR_FAILED' end as error")
    tail = lists.tail_table(lists.first_wins(listed(spark, d)))
    return policy.network_blocks(rows, tail, spark.createDataFrame([("d6.example.com",)], "domain string")).select("nav", "category")


@query(
    f"with m as (select count(*) as n, count(*) filter (y_true = 'clean' and y_pred <> 'clean') / greatest(1, count(*) filter (y_true = 'clean'))::double as fp, count(*) filter (y_true = 'adult' and y_pred <> 'clean') / greatest(1, count(*) filter (y_true = 'adult'))::double as re from ({TRUTH})) "
    "select n, round(fp, 4) as observed, round(fp + 0.01, 4) as ceiling, round(greatest(0, re - 0.03), 4) as floor, 0 as failures, 2 as failures_of_worse from m"
)
def gate_and_baseline(spark, d):
    m = metrics.measure(standin(spark, d, TRUTH), ["adult"]).first().asDict()
    b = metrics.baseline(m, ["adult"])
    worse = m | {"clean_fp_rate": m["clean_fp_rate"] + 0.5, "recall_adult": -1.0}
    return spark.createDataFrame([(b["n"], b["observed"]["clean_fp_rate"], b["clean_fp_ceiling"], b["recall_floor"]["adult"], len(metrics.gate(m, b)), len(metrics.gate(worse, b)))], "n long, observed double, ceiling double, floor double, failures int, failures_of_worse int")


@query(f"select round(avg((y_true = y_pred)::int), 9) as accuracy, round(count(*) filter (y_true = 'clean' and confidence >= 0.9) / greatest(1, count(*) filter (y_true = 'clean'))::double, 9) as fp_rate, round(count(*) filter (y_true <> 'clean' and confidence >= 0.9) / greatest(1, count(*) filter (y_true <> 'clean'))::double, 9) as recall from ({TRUTH})")
def bakeoff_at_threshold(spark, d):
    rows = standin(spark, d, TRUTH)
    return metrics.bakeoff(rows, rows, ["adult", "clean", "gambling"]).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "fp_rate", "recall")])


# ---- streams -------------------------------------------------------------------

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _streamed(spark: SparkSession, rows: DataFrame, f, mode: str = "append") -> DataFrame:
    """What a stream over `rows`, stored as files and read in batches to its end, has written."""
    root = shared_folder(spark)
    rows.repartitionByRange(4, "t").sortWithinPartitions("t", "seq").write.parquet(f"{root}/in")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(f"{root}/in")
        to = f"{root}/out"

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

        f(source).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.parquet(to).drop("batch")


@query(f"select seq, tab, t, domain from (select *, lag(domain) over w as pd, lag(t) over w as pt from ({EVENTS_DUCK}) window w as (partition by tab order by t, seq)) where pt is null or pd <> domain or t - pt >= 3000")
def streamed_log(spark, d):
    return _streamed(spark, events(spark, d), state.logged).select("seq", "tab", "t", "domain")


@query(f"select seq, last_value(case when seq % 3 = 0 then domain end ignore nulls) over (partition by tab order by t, seq rows between unbounded preceding and current row) as real_host from ({EVENTS_DUCK})")
def streamed_attribution(spark, d):
    rows = events(spark, d).select("tab", "t", "seq", F.lit("nav").alias("kind"), F.expr("case when seq % 3 = 0 then domain end").alias("host"))
    return _streamed(spark, rows, state.attributed).select("seq", "real_host")


@query(f"select strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day, category, source, count(*) as n from ({EVENTS_DUCK}) group by all")
def streamed_counters(spark, d):
    return _streamed(spark, events(spark, d), state.counters, "complete").select(F.col("day").cast("string").alias("day"), "category", "source", "n")


@query(
    f"with recursive e as (select tab, t, seq, row_number() over (partition by tab order by t, seq) as i from ({EVENTS_DUCK})), "
    "r as (select tab, t, seq, i, t as last, true as accepted from e where i = 1 union all select e.tab, e.t, e.seq, e.i, case when e.t - r.last >= 86400000 then e.t else r.last end, e.t - r.last >= 86400000 from r join e on e.tab = r.tab and e.i = r.i + 1) select tab, t, seq, accepted from r"
)
def streamed_rate_limit(spark, d):
    return _streamed(spark, events(spark, d).select("tab", "t", "seq"), lambda s: state.rate_limited(s, 86_400_000))
