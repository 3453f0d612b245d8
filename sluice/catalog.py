"""All queries of the library over the driver's tables, each with its DuckDB twin.

The tables have no domain lists, block events or scored pages, so stand-ins are
derived from them by the expressions below, which both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import detect, text, urls
from sluice.functions.html import page_features
from sluice.operators import blocklog, corpus, lists, lookup, metrics, scoring
from sluice.operators.rank import numbered
from sluice.plans import policy

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

# Stand-ins: SQL that Spark and DuckDB both run on one table.
HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
NUM = "cast({} as string)"
LISTED = (
    "select case when c_custkey % 3 = 0 then concat('s', cast(c_custkey % 7 as string), '.d', cast(c_custkey % 97 as string), '.example.com') "
    "when c_custkey % 3 = 1 then concat('d', cast(c_custkey % 97 as string), '.example.com') "
    "else concat('w', cast(c_custkey % 211 as string), '.net') end as domain, "
    "cast(c_nationkey % 5 as int) as cat, cast(c_custkey % 3 as int) as src, cast(c_custkey as bigint) as seq from customer"
)
RANKED = "select concat('d', cast(p_partkey % 131 as string), '.example.com') as domain, min(p_partkey) as rank from part group by 1"
NAVIGATED = "select cast(o_orderkey as bigint) as nav, concat(case when o_orderkey % 2 = 0 then 'x.' else '' end, case when o_orderkey % 3 = 0 then 's1.' else '' end, 'd', cast(o_custkey % 150 as string), '.example.com') as host from orders"
EVENTS = (
    "select cast(user_id as bigint) as tab, {ms} as t, cast(event_id as bigint) as seq, concat('d', regexp_extract(props, '\"k\": *([0-9]+)', 1)) as domain, "
    "event_type as category, case event_id % 4 when 0 then 'list' when 1 then 'model' when 2 then 'proxy' else 'district-policy' end as source from events"
)
TRUTH = (
    "select cast(doc_id as bigint) as doc_id, case when toxic = 1 then 'adult' when quality = 0 then 'gambling' else 'clean' end as y_true, "
    "case when doc_id % 10 < 7 then (case when toxic = 1 then 'adult' when quality = 0 then 'gambling' else 'clean' end) when doc_id % 10 = 7 then 'clean' when doc_id % 10 = 8 then 'adult' else 'gambling' end as y_pred, "
    "cast((doc_id * 37) % 1000 as double) / 1000 as confidence from labels"
)
MS = {"spark": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))", "duckdb": "(epoch_us(ts) // 1000)"}
EVENTS_DUCK = EVENTS.format(ms=MS["duckdb"])
_FNV64 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({s}) + 1), lambda i: ord({s}[i])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) & 18446744073709551615::HUGEINT)"
_FNV32 = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ord({s}[i])::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"



def fnv32(s: str) -> str:
    return _FNV32.format(s=f"({s})")


def fnv64(s: str) -> str:
    return f"lpad(lower(to_hex({_FNV64.format(s=f'({s})')}::UHUGEINT)), 16, '0')"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def standin(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """One of the SQL stand-ins above, on its table."""
    name = sql.split(" from ")[-1].split()[0]
    return spark.sql(sql.format(ms=MS["spark"]).replace(f" from {name}", " from {__t}"), __t=table(spark, d, name))


def listed(spark, d):
    return standin(spark, d, LISTED)


def events(spark, d):
    return spark.sql(EVENTS.replace("{ms}", MS["spark"]).replace(" from events", " from {__t}"), __t=table(spark, d, "events"))


def page_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", "url", urls.hostname("url").alias("host"))


# ---- domains and URLs -------------------------------------------------------


@query(f"select page_id, {HOST} as host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') as path from pages")
def src_pages_hosts(spark, d):
    return page_hosts(spark, d).select("page_id", "host", urls.pathname("url").alias("path"))


_LINE = f"case page_id % 8 when 0 then concat('0.0.0.0 ', {HOST}) when 1 then concat('*.', {HOST}) when 2 then concat(upper({HOST}), '.') when 3 then concat('# ', {HOST}) when 4 then concat({HOST}, ' # note') when 5 then concat('www.', {HOST}) when 6 then '127.0.0.1 localhost' else concat('  ', {HOST}, '  ') end"


@query(f"select page_id, case when page_id % 8 in (3, 6) then null when page_id % 8 = 5 then {HOST} when regexp_matches({HOST}, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)+[a-z][a-z0-9-]*[a-z0-9]$') then regexp_replace({HOST}, '^www\\.', '') end as domain from pages")
def normalize_domain(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.expr(_LINE).alias("line"))
    return lines.select("page_id", urls.normalize_domain("line").alias("domain"))


_SUFFIXES = f"select page_id, host, array_to_string(list_slice(l, i, len(l)), '.') as suffix from (select page_id, {HOST} as host, string_split({HOST}, '.') as l from pages) t, unnest(range(1, len(l))) as u(i)"


@query(_SUFFIXES)
def host_suffixes(spark, d):
    return page_hosts(spark, d).select("page_id", "host", F.explode(urls.domain_suffixes("host")).alias("suffix"))


@query(f"select page_id, array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') as site from pages")
def last_two_labels(spark, d):
    return page_hosts(spark, d).select("page_id", urls.last_two_labels("host").alias("site"))


@query(f"select page_id, array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') as etld1 from pages")
def etld1(spark, d):
    return urls.registrable_domain(page_hosts(spark, d), "host").select("page_id", "etld1")


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https://', ''), '^http://', ''), '/+$', '') as domain from pages")
def domain_of_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.domain_of_url("url").alias("domain"))


def _present(words):
    return " + ".join(f"contains(lower(url), '{w}')::int" for w in words)


def _entropy_sql(s: str) -> str:
    return f"coalesce((select sum(-(c / length({s})::double) * log2(c / length({s})::double)) from (select count(*) as c from unnest(string_split({s}, '')) as u(x) group by x)), 0)"


_PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/')"
_COUNT = "len(regexp_extract_all(url, '{}'))"


@query(
    f"select page_id, length(url)::int as url_length, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))::int as path_depth, "
    "len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''))::int as query_param_count, "
    f"round({_COUNT.format('[0-9]')} / length(url)::double, 9) as url_digit_ratio, {_COUNT.format('-')}::int as url_hyphen_count, {_COUNT.format('%[0-9a-fA-F]{2}')}::int as url_pct_encoded_count, "
    f"round({_entropy_sql(HOST)}, 6) as host_entropy, round({_entropy_sql(_PATH)}, 6) as path_entropy, greatest(0, len(string_split({HOST}, '.')) - 2)::int as subdomain_depth, "
    f"regexp_matches({HOST}, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$')::int as is_ip_literal_host, regexp_matches({HOST}, '\\.({'|'.join(urls.CHEAP_TLDS)})$')::int as is_cheap_tld, "
    + ", ".join(f"({_present(w)})::int as {n}" for n, w in urls.URL_WORDS.items())
    + " from pages"
)
def url_lexical(spark, d):
    places = {"url_digit_ratio": 9, "host_entropy": 6, "path_entropy": 6}
    f = urls.lexical_features("url")
    return table(spark, d, "pages").select("page_id", *[(F.round(c, places[n]) if n in places else c.cast("int")).alias(n) for n, c in f.items()])


@query("select page_id, (page_id % 4 in (1, 2)) as is_proxy from pages")
def proxy_urls(spark, d):
    base = F.lit("https://p.example.com/service/")
    coded = F.base64(F.col("url").cast("binary"))
    made = F.when(F.col("page_id") % 4 == 0, F.concat(base, F.lit("https:/plain"))).when(F.col("page_id") % 4 == 1, F.concat(base, F.lit("https%3A%2F%2Fgames.example.org%2F"))).when(F.col("page_id") % 4 == 2, F.concat(base, F.regexp_replace(F.translate(coded, "+/", "-_"), r"[\r\n=]", ""))).otherwise(F.concat(base, F.lit("?u="), coded))
    return table(spark, d, "pages").select("page_id", urls.looks_like_proxy_url(made).alias("is_proxy"))


_SERP = "case nav % 6 when 0 then 'https://www.google.com/search?q=x' when 1 then 'https://google.com/' when 2 then 'https://translate.google.com/search' when 3 then 'https://duckduckgo.com/html/' when 4 then 'https://www.bing.com/searching' else 'https://search.brave.com/search/x' end"


@query("select nav, nav % 6 in (0, 1, 3, 5) as is_search from (select cast(o_orderkey as bigint) as nav from orders)")
def search_pages(spark, d):
    return standin(spark, d, NAVIGATED).select("nav", urls.is_search_url(F.expr(_SERP)).alias("is_search"))


@query(f"select nav, case when host = 'd7.example.com' or host like '%.d7.example.com' then 'd7.example.com' when host = 'x.d9.example.com' then 'x.d9.example.com' end as matched from ({NAVIGATED})")
def suffix_host_match(spark, d):
    wanted = F.array(F.lit("d7.example.com"), F.lit("x.d9.example.com"))
    return standin(spark, d, NAVIGATED).select("nav", urls.matches_suffix(F.col("host"), wanted).alias("matched"))


@query("select nav, case nav % 3 when 0 then 'a1.games.lol|b.example.org' when 1 then '' else 'x.example.com' end as hosts from (select cast(o_orderkey as bigint) as nav from orders)")
def hosts_in_text(spark, d):
    made = F.expr("case nav % 3 when 0 then 'see https://A1.games.lol/x and b.example.org, not logo.png' when 1 then 'nothing here youtube.com' else 'X.example.com discord.gg' end")
    return standin(spark, d, NAVIGATED).select("nav", F.array_join(urls.hosts_in_text(made), "|").alias("hosts"))


# ---- hashes and text ---------------------------------------------------------

_TOKENS = "select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents"


@query(f"select token, {fnv32('token')} as h from ({_TOKENS})")
def fnv1a32_tokens(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(text.words("text")).alias("token")).distinct()
    return tokens.select("token", text.fnv1a32("token").alias("h"))


@query(f"select distinct host, {fnv64('host')} as h from (select {HOST} as host from pages)")
def fnv1a64_hosts(spark, d):
    return page_hosts(spark, d).select("host").distinct().select("host", text.hex64(text.fnv1a64("host")).alias("h"))





@query(
    "with w as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from benchmark), p as (select item_id, ws, unnest(range(1, len(ws) + 1)) as i from w), "
    "t as (select item_id, ws[i] as term from p union all select item_id, ws[i] || ' ' || ws[i + 1] from p where i < len(ws) "
    "union all select item_id, '#' || substr('^' || ws[i] || '$', j, k) from p, unnest(range(1, 300)) as a(j), unnest([3, 4]) as b(k) where j + k - 1 <= length(ws[i]) + 2) "
    "select item_id, term, count(*) as n from t group by all"
)
def terms_of_benchmark(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(text.terms("text")).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query(
    "with w as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from benchmark), p as (select item_id, ws, unnest(range(1, len(ws) + 1)) as i from w), "
    "t as (select item_id, ws[i] as term from p union all select item_id, ws[i] || ' ' || ws[i + 1] from p where i < len(ws) "
    "union all select item_id, '#' || substr('^' || ws[i] || '$', j, k) from p, unnest(range(1, 300)) as a(j), unnest([3, 4]) as b(k) where j + k - 1 <= length(ws[i]) + 2), "
    f"h as (select item_id, {fnv32('term')} as h from t), a as (select item_id, h & 65535 as idx, sum(case when (h >> 31) & 1 = 1 then -1 else 1 end)::double as x from h group by all), "
    "n as (select item_id, sqrt(sum(x * x)) as norm from a group by 1) select item_id, idx, round(x / norm, 9) as value from a join n using (item_id) where norm > 0"
)
def term_vectors(spark, d):
    v = text.term_vector(table(spark, d, "benchmark"), "item_id", "text")
    return v.select("item_id", "idx", F.round("value", 9).alias("value"))


_SIMHASH = (
    "with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as w from documents), c as (select doc_id, w, count(*) as n from t group by all), "
    f"hashed as (select w, {fnv32('w')} as a, {fnv32('reverse(w)')} as z from (select distinct w from t)), "
    "v as (select doc_id, b, sum(case when (case when b < 32 then (z >> b) else (a >> (b - 32)) end) & 1 = 1 then n else -n end) as s from c join hashed using (w), unnest(range(0, 64)) as u(b) group by all), "
    "s as (select doc_id, sum(case when s > 0 then (1::HUGEINT << b) else 0 end) as h from v group by 1), "
    "sh as (select documents.doc_id, coalesce(h, 0)::HUGEINT as h, lang from documents left join s using (doc_id))"
)


@query(_SIMHASH + " select doc_id, lpad(lower(to_hex(h::UHUGEINT)), 16, '0') as simhash from sh")
def simhash64(spark, d):
    return text.simhash(table(spark, d, "documents"), "doc_id", "text").select("doc_id", text.hex64("simhash").alias("simhash"))


@query(
    _SIMHASH + ", l as (select lang, list(struct_pack(i := doc_id, h := h) order by doc_id) as rows from sh group by lang), "
    "k as (select lang, list_reduce(list_prepend([]::STRUCT(i BIGINT, h HUGEINT)[], list_transform(rows, lambda r: [struct_pack(i := r.i, h := r.h)])), "
    "lambda kept, r: case when len(list_filter(kept, lambda x: bit_count(xor(x.h, r[1].h)) <= 4)) > 0 then kept else list_concat(kept, r) end) as kept from l) "
    "select x.i as doc_id, lang from (select lang, unnest(kept) as x from k)"
)
def neardup_greedy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return corpus.without_near_duplicates(docs, "doc_id", "lang", "text").select("doc_id", "lang")


@query("select doc_id, array_to_string(list_slice(list_filter(string_split_regex(regexp_replace(substr(text, 1, 6400), '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), 1, 400), ' ') as body from documents")
def record_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.record_text("text").alias("body"))


@query("select doc_id, sha256(text) as digest, length(text)::int as n from documents")
def text_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


_AGO = "(86400000::BIGINT * 20000 - t)"


@query(f"select seq, case when {_AGO} < 60000 then 'just now' when {_AGO} < 3600000 then ({_AGO} // 60000) || 'm ago' when {_AGO} < 86400000 then ({_AGO} // 3600000) || 'h ago' else ({_AGO} // 86400000) || 'd ago' end as ago from ({EVENTS_DUCK})")
def relative_times(spark, d):
    return events(spark, d).select("seq", text.relative_time(F.col("t"), F.lit(86_400_000 * 20_000)).alias("ago"))


@query(f"select seq, upper(category[1] || source[1] || '-' || strftime(make_timestamp(t * 1000), '%Y%m%d%H%M')) as code, case source when 'list' then 'URL filter' when 'model' then 'Content model' when 'proxy' then 'Web-proxy detector' else 'District policy' end as name from ({EVENTS_DUCK})")
def reference_codes(spark, d):
    at = F.expr("timestampadd(MILLISECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return events(spark, d).select("seq", text.reference_code(F.col("category"), F.col("source"), at).alias("code"), text.source_name("source").alias("name"))


@query(
    "select doc_id, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 9) as p0, round(exp(c - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 9) as p2 from "
    "(select *, greatest(a, b, c) as m from (select doc_id, (doc_id % 13)::double / 3 as a, (doc_id % 7)::double / 2 as b, (doc_id % 5)::double as c from documents))"
)
def softmax_scores(spark, d):
    z = F.array((F.col("doc_id") % 13).cast("double") / 3, (F.col("doc_id") % 7).cast("double") / 2, (F.col("doc_id") % 5).cast("double"))
    p = text.softmax(z)
    return table(spark, d, "documents").select("doc_id", F.round(p[0], 9).alias("p0"), F.round(p[2], 9).alias("p2"))


# ---- lists -------------------------------------------------------------------

_FIRST = f"first as (select domain, cat, src, seq from ({LISTED}) qualify row_number() over (partition by domain order by cat, src, seq) = 1)"
_ANCESTORS = "anc as (select domain, cat, array_to_string(list_slice(string_split(domain, '.'), i, len(string_split(domain, '.'))), '.') as up from {t}, unnest(range({lo}, len(string_split(domain, '.')))) as u(i))"
_PRUNED = f"with {_FIRST}, {_ANCESTORS.format(t='first', lo=2)}, kept as (select * from first where not exists (select 1 from anc join first f on f.domain = anc.up and f.cat = anc.cat where anc.domain = first.domain))"


@query(f"with {_FIRST} select * from first")
def first_wins_dedupe(spark, d):
    return lists.first_wins(listed(spark, d))


@query(f"with {_FIRST}, p as (select cat, src, count(*) as parsed from ({LISTED}) group by all), n as (select cat, src, count(*) as new from first group by all) select cat, src, parsed, coalesce(new, 0) as new from p left join n using (cat, src)")
def source_counts(spark, d):
    return lists.source_counts(listed(spark, d))


@query(f"with {_FIRST}, {_ANCESTORS.format(t='first', lo=1)}, allow as (select distinct domain from ({RANKED}) where rank % 4 = 0) select domain, cat from first where domain not in (select anc.domain from anc join allow on anc.up = allow.domain)")
def allow_antijoin(spark, d):
    allow = standin(spark, d, RANKED).where("rank % 4 = 0").select("domain")
    return lists.without_allowed(lists.first_wins(listed(spark, d)), allow).select("domain", "cat")


@query(_PRUNED + " select domain, cat from kept")
def ancestor_prune(spark, d):
    return lists.without_covered(lists.first_wins(listed(spark, d))).select("domain", "cat")


@query(_PRUNED + f" select domain, cat, coalesce(rank, -1) as rank from (select domain, kept.cat, kept.src, kept.seq, rank from kept left join ({RANKED}) r using (domain) order by rank asc nulls last, cat, src, seq, domain limit 120)")
def tier1_topn(spark, d):
    table_ = lists.without_covered(lists.first_wins(listed(spark, d)))
    return lists.first_tier(table_, standin(spark, d, RANKED), 120).select("domain", "cat", "rank").na.fill(-1, ["rank"])


@query(f"with {_FIRST} select {fnv64('domain')} as h, cat, domain, row_number() over (order by {fnv64('domain')}) as pos from first")
def hash_sorted_table(spark, d):
    tail = lists.tail_table(lists.first_wins(listed(spark, d)))
    return numbered(tail, text.unsigned_order("h"), F.col("domain"), name="pos").select(text.hex64("h").alias("h"), "cat", "domain", (F.col("pos") + 1).alias("pos"))


@query(f"with {_FIRST} select {fnv64('domain')} as h, count(*) as n from first group by 1 having count(*) > 1")
def hash_collisions(spark, d):
    return lists.collisions(lists.tail_table(lists.first_wins(listed(spark, d)))).select(text.hex64("h").alias("h"), "n")


@query(
    f"with recursive {_FIRST}, tier as (select domain, row_number() over (order by cat, src, seq, domain) - 1 as pos from first), "
    "scan as (select pos, domain, 0::BIGINT as rule, 1 as held, 140 + length(domain) + 3 as used from tier where pos = 0 union all "
    "select t.pos, t.domain, case when s.held >= 5 or s.used + length(t.domain) + 3 > 1800 then s.rule + 1 else s.rule end, case when s.held >= 5 or s.used + length(t.domain) + 3 > 1800 then 1 else s.held + 1 end, "
    "case when s.held >= 5 or s.used + length(t.domain) + 3 > 1800 then 140 + length(t.domain) + 3 else s.used + length(t.domain) + 3 end from scan s join tier t on t.pos = s.pos + 1) "
    "select pos, domain, (rule // 4)::int as chunk, rule + 1 as rule_id from scan where (rule // 4) * 4 < 28"
)
def rule_packing(spark, d):
    first = lists.first_wins(listed(spark, d))
    tier = numbered(first, *map(F.col, ("cat", "src", "seq", "domain")), name="pos").select("domain", "pos")
    return lists.pack_rules(tier, domains_per_rule=5, rules_per_chunk=4, max_rules=28)


@query(f"with {_FIRST} select domain, 'c' || cat as label from first union all (select domain, 'clean' from ({RANKED}) where domain not in (select domain from first) order by rank, domain limit 40)")
def label_rows(spark, d):
    return lists.label_rows(lists.first_wins(listed(spark, d)), standin(spark, d, RANKED), {i: f"c{i}" for i in range(5)}, 40)


@query("with a as (select 'f' || s_suppkey as file, 'x' || (s_suppkey % 5) as old from supplier where s_suppkey % 3 <> 0), b as (select 'f' || s_suppkey as file, 'x' || (s_suppkey % 4) as new from supplier where s_suppkey % 4 <> 0) select file, case when old is null then 'added' when new is null then 'stale' else 'changed' end as state from a full join b using (file) where old is distinct from new")
def changed_chunks(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file")
    sha = lambda n: F.concat(F.lit("x"), (F.col("s_suppkey") % n).cast("string")).alias("sha256")
    return lists.changed_chunks(s.where("s_suppkey % 3 <> 0").select(name, sha(5)), s.where("s_suppkey % 4 <> 0").select(name, sha(4)))


_LOOKUP = f"with {_FIRST}, h as (select distinct host from ({NAVIGATED})), c as (select host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as up, i from h, unnest(range(1, len(string_split(host, '.')))) as u(i)), hit as (select host, up as matched, cat from c join first on first.domain = c.up qualify row_number() over (partition by host order by i) = 1)"


@query(_LOOKUP + " select * from hit")
def tail_lookup(spark, d):
    return lookup.longest_listed(standin(spark, d, NAVIGATED), lists.tail_table(lists.first_wins(listed(spark, d))))


@query(_LOOKUP + f" select nav, host, case when host like '%d5.example.com' and (host = 'd5.example.com' or host like '%.d5.example.com') then 'allow' when host = 'd6.example.com' or host like '%.d6.example.com' then 'block' when matched is not null then 'block' else 'allow' end as action, case when host = 'd5.example.com' or host like '%.d5.example.com' then null when host = 'd6.example.com' or host like '%.d6.example.com' then 'district-policy' when matched is not null then 'list' end as source from ({NAVIGATED}) n left join hit using (host)")
def navigation_decisions(spark, d):
    n = standin(spark, d, NAVIGATED).withColumn("url", F.concat(F.lit("https://"), F.col("host"), F.lit("/page"))).drop("host").withColumn("frame", F.lit(0))
    one = lambda s: spark.createDataFrame([(s,)], "domain string")
    pins = spark.createDataFrame([], "host string, category string")
    no_pin = spark.createDataFrame([], "host string")
    tail = lists.tail_table(lists.first_wins(listed(spark, d)))
    return policy.navigation_verdicts(n, tail, one("d5.example.com"), one("d6.example.com"), pins, no_pin).select("nav", "host", "action", "source")


# ---- corpus ------------------------------------------------------------------


@query("select doc_id from documents where length(regexp_replace(text, '\\s+', '', 'g')) >= 80 and not regexp_matches(lower(text), '" + "|".join(p.replace("'", "''").replace("&", "&") for p in corpus.PARKED + corpus.CHALLENGE + corpus.REMOVED) + "')")
def usable_filter(spark, d):
    empty = F.lit("")
    return table(spark, d, "documents").where(corpus.is_usable(empty, empty, F.col("text"))).select("doc_id")


#: The driver's texts hold none of the fixed vocabulary, so the query looks for some of their own words.
SIGNALS = {"a": (("the", "of"), ("the of",)), "b": (("que", "la", "les"), ()), "c": (("der", "die", "und", "ist"), ("ist das",))}


def _hits(words, phrases):
    return " + ".join([f"regexp_matches(' ' || lower(regexp_replace(text, '[^A-Za-z0-9À-ɏ_]', ' ', 'g')) || ' ', ' {w} ')::int" for w in words] + [f"contains(lower(text), '{p}')::int" for p in phrases])


@query("select doc_id, case when a > 1 and a >= b and a >= c then 'a' when b > 1 and b >= c then 'b' when c > 1 then 'c' end as category from (select doc_id, " + ", ".join(f"{_hits(*v)} as {k}" for k, v in SIGNALS.items()) + " from documents)")
def contamination(spark, d):
    return table(spark, d, "documents").select("doc_id", corpus.contamination(F.col("text"), SIGNALS).alias("category"))


@query("select lang, count(*) filter (category is null) as kept, count(*) filter (category is not null) as quarantined from (select lang, case when lang = 'en' and a > 1 then 'a' end as category from (select lang, " + _hits(*SIGNALS["a"]) + " as a from documents)) group by lang")
def partition_clean(spark, d):
    rows = corpus.with_contamination(table(spark, d, "documents"), "en", "lang", F.col("text"), {"a": SIGNALS["a"]})
    return rows.groupBy("lang").agg(F.sum(F.col("contamination").isNull().cast("long")).alias("kept"), F.sum(F.col("contamination").isNotNull().cast("long")).alias("quarantined"))


@query(f"with k as (select source, row_number() over (order by {fnv32(chr(39) + '0|' + chr(39) + ' || source')}, source) - 1 as n, count(*) over () as total from (select distinct source from documents)) select doc_id, source, case when n < floor(total * 0.8) then 'train' when n < floor(total * 0.8) + floor(total * 0.1) then 'val' else 'test' end as split from documents join k using (source)")
def split_by_group(spark, d):
    return corpus.split_by_key(table(spark, d, "documents").select("doc_id", "source"), "source", (0.8, 0.1, 0.1)).select("doc_id", "source", "split")


@query(f"select lang, doc_id from documents qualify row_number() over (partition by lang order by {fnv32(chr(39) + '0|' + chr(39) + ' || doc_id::varchar')}, doc_id) <= 25")
def per_label_sample(spark, d):
    return corpus.sample_per_label(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 25)


@query(
    f"with {_FIRST}, rows as (select domain, 'c' || cat as label from first where not contains(domain, 'd13')), "
    f"o as (select label, domain, rank, row_number() over (partition by label order by case when label in ('c0', 'c1') and rank is not null then 1 else 2 end, case when label in ('c0', 'c1') then rank end nulls last, {fnv32(chr(39) + '0|' + chr(39) + ' || domain')}, domain)::int as pos from rows left join ({RANKED}) r using (domain)) select label, domain, pos from o"
)
def pools_popular_first(spark, d):
    rows = lists.first_wins(listed(spark, d)).select("domain", F.concat(F.lit("c"), F.col("cat").cast("string")).alias("label"))
    return corpus.pools(rows, standin(spark, d, RANKED), popular_first=("c0", "c1"), deny=("d13",))


@query(f"with {_FIRST} select domain, cat from first where domain not in (select domain from ({RANKED})) and domain not in (select domain from first where seq % 5 = 0)")
def remaining_antijoin(spark, d):
    first = lists.first_wins(listed(spark, d))
    return corpus.remaining(first, standin(spark, d, RANKED), first.where("seq % 5 = 0")).select("domain", "cat")


@query("select doc_id, source from documents where lang = 'fr' and source not in (select source from documents where lang = 'es' and doc_id % 3 = 0)")
def hardneg_leak_guard(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return corpus.remaining(docs.where("lang = 'fr'"), docs.where("lang = 'es' and doc_id % 3 = 0"), key="source").select("doc_id", "source")


@query(f"select lang, fold::int as fold, count(*) as n from (select lang, ntile(5) over (partition by lang order by {fnv32(chr(39) + '0|' + chr(39) + ' || doc_id::varchar')}, doc_id) as fold from documents) group by all")
def stratified_folds(spark, d):
    return scoring.folds(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id").groupBy("lang", "fold").agg(F.count("*").alias("n"))


@query("with o as (select l_orderkey as topic, 'u' || l_partkey as url, l_linenumber as seq from lineitem), f as (select topic, url, min(seq) as seq from o group by all) select topic, url, (row_number() over (partition by topic order by seq, url))::int as pos from f qualify row_number() over (partition by topic order by seq, url) <= 3")
def seed_urls_capped(spark, d):
    from sluice.sources.writers import seed_urls

    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("topic"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_linenumber").alias("seq"))
    return seed_urls(rows, 3)


# ---- block log ---------------------------------------------------------------


@query(f"select seq, tab, t, domain from (select *, lag(domain) over w as pd, lag(t) over w as pt from ({EVENTS_DUCK}) window w as (partition by tab order by t, seq)) where pt is null or pd <> domain or t - pt >= 3000")
def blocklog_dedupe(spark, d):
    return blocklog.logged(events(spark, d)).select("seq", "tab", "t", "domain")


_REAL = "case when seq % 3 = 0 then domain end"


@query(f"select seq, last_value({_REAL} ignore nulls) over (partition by tab order by t, seq rows between unbounded preceding and current row) as real_host from ({EVENTS_DUCK})")
def last_real_host(spark, d):
    return blocklog.attributed(events(spark, d).withColumn("host", F.expr(_REAL))).select("seq", "real_host")


@query(f"with l as (select tab, arg_max(domain, t * 1000000 + seq) as host from ({EVENTS_DUCK}) group by tab) select tab, host from l where host in (select 'd' || i from unnest(range(0, 100, 2)) as u(i))")
def tabs_on_hosts(spark, d):
    wanted = spark.createDataFrame([(f"d{i}",) for i in range(0, 100, 2)], "host string")
    return blocklog.tabs_on(events(spark, d).withColumn("host", F.col("domain")), wanted)


@query(f"select 'category' as by, category as key, count(*) as n from ({EVENTS_DUCK}) group by all union all select 'source', source, count(*) from ({EVENTS_DUCK}) group by all")
def blocklog_totals(spark, d):
    e = events(spark, d)
    return blocklog.totals(e, "category").select(F.lit("category").alias("by"), "key", "n").unionByName(blocklog.totals(e, "source").select(F.lit("source").alias("by"), "key", "n"))


@query(f"with f as (select domain, count(*) as n, min(t * 1000000 + seq) as k from ({EVENTS_DUCK}) group by 1), r as (select *, row_number() over (order by k, domain) as i from f) select case when i <= 20 then domain else '(other)' end as domain, sum(n)::bigint as n from r group by 1")
def blocklog_capped_domains(spark, d):
    return blocklog.capped_domains(events(spark, d), 20)


@query(f"with c as (select strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day, category, count(*) as n from ({EVENTS_DUCK}) group by all) select * from c where day in (select distinct day from c order by day desc limit 7)")
def blocklog_by_day(spark, d):
    return blocklog.per_day(events(spark, d), 7)


@query(f"with c as (select strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day, count(*) as n from ({EVENTS_DUCK}) group by 1) select strftime(g, '%Y-%m-%d') as day, coalesce(n, 0) as n from (select unnest(generate_series(DATE '2024-01-16', DATE '2024-02-14', INTERVAL 1 DAY)) as g) left join c on c.day = strftime(g, '%Y-%m-%d')")
def blocklog_daily_series(spark, d):
    return blocklog.daily_series(events(spark, d), "2024-02-14")


@query(f"select domain as key, count(*) as n from ({EVENTS_DUCK}) group by 1 order by n desc, key limit 25")
def top_domains(spark, d):
    return blocklog.top(blocklog.totals(events(spark, d), "domain"), "key", 25)


@query(f"select seq, t, domain from ({EVENTS_DUCK}) order by t desc, seq desc limit 50")
def latest_events(spark, d):
    return blocklog.latest(events(spark, d), 50).select("seq", "t", "domain")


@query(f"select host, category, t, seq from (select domain as host, category, t, seq, row_number() over (partition by domain order by t, seq) as n from ({EVENTS_DUCK})) where n = 1 order by t desc, seq desc limit 30")
def first_pins(spark, d):
    pins = events(spark, d).select(F.col("domain").alias("host"), "category", F.lit(1.0).alias("confidence"), "t", "seq")
    return blocklog.first_pins(pins, 30).select("host", "category", "t", "seq")


@query(
    f"with recursive e as (select tab, t, seq, row_number() over (partition by tab order by t, seq) as i from ({EVENTS_DUCK})), "
    "r as (select tab, t, seq, i, t as last, true as accepted from e where i = 1 union all select e.tab, e.t, e.seq, e.i, case when e.t - r.last >= 86400000 then e.t else r.last end, e.t - r.last >= 86400000 from r join e on e.tab = r.tab and e.i = r.i + 1) select tab, t, seq, accepted from r"
)
def rate_limited_requests(spark, d):
    return blocklog.rate_limited(events(spark, d).select("tab", "t", "seq"), 86_400_000)


# ---- detectors and decisions ---------------------------------------------------

_S = {
    "link_density": "cast(doc_id % 10 as double) / 10", "paragraph_count": "cast(doc_id % 7 as int)", "has_dominant_canvas": "doc_id % 11 = 0", "url_embeds_url": "doc_id % 13 = 0",
    "has_url_like_input": "doc_id % 5 = 0", "has_video_player": "doc_id % 3 = 0", "has_large_xorigin_iframe": "doc_id % 17 = 0", "has_gambling_license_seal": "doc_id % 19 = 0",
    "fp_proxy_marker_count": "cast(doc_id % 23 = 0 as int)", "has_age_gate": "doc_id % 29 = 0", "has_payment_field": "doc_id % 31 = 0",
}
_CAT = "case doc_id % 5 when 0 then 'adult' when 1 then 'gambling' when 2 then 'proxy-bypass' when 3 then 'games' else 'clean' end"
_PAGES = "(select doc_id, {c} as cat, {f} from documents)".format(c=_CAT, f=", ".join(f"{e} as {n}" for n, e in _S.items()))
_RESCUE = (
    "(link_density < 0.33 and paragraph_count >= 3 and not has_dominant_canvas and case cat when 'proxy-bypass' then not (url_embeds_url or has_url_like_input) when 'adult' then not has_video_player when 'gambling' then not (has_large_xorigin_iframe or has_gambling_license_seal) else false end)"
)


def _structured(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(_CAT).alias("cat"), *[F.expr(e).alias(n) for n, e in _S.items()])
    return docs.withColumn("s", F.struct(*_S))


@query(f"select doc_id, {_RESCUE} as rescued, coalesce(case cat when 'proxy-bypass' then url_embeds_url or fp_proxy_marker_count > 0 or (has_url_like_input and paragraph_count < 5) when 'adult' then has_video_player or has_age_gate when 'gambling' then has_large_xorigin_iframe or has_gambling_license_seal or has_payment_field when 'games' then has_dominant_canvas else false end, false) as pinned from {_PAGES}")
def rescue_and_pin(spark, d):
    s = _structured(spark, d)
    return s.select("doc_id", detect.is_article_about(F.col("cat"), F.col("s")).alias("rescued"), detect.works_as(F.col("cat"), F.col("s")).alias("pinned"))


_CLASSES = ["adult", "clean", "gambling", "games", "proxy-bypass"]
_P = [f"cast((doc_id * {k}) % 101 as double) / 100" for k in (7, 11, 13, 17, 19)]
_Q = [f"cast((doc_id * {k}) % 103 as double) / 102" for k in (23, 29, 31, 37, 41)]


def _top(ps: list[str]) -> tuple[str, str]:
    names = [(c, p) for c, p in zip(_CLASSES, ps, strict=True) if c != "clean"]
    best = f"greatest({', '.join(p for _, p in names)})"
    return "case " + " ".join(f"when {p} = {best} then '{c}'" for c, p in names) + " end", best


@query(
    f"select doc_id, case when fp >= 0.97 then fc when tp >= 0.89 and not rescued then tc else 'clean' end as category, case when fp >= 0.97 then fp when tp >= 0.89 and not rescued then tp else greatest(fp, tp) end as confidence, case when fp >= 0.97 then 'fusion' when tp >= 0.89 and not rescued then 'text-backstop' else '-' end as reason "
    f"from (select *, {_RESCUE.replace('cat ', 'tc ')} as rescued from (select *, {_top(_Q)[0]} as fc, {_top(_Q)[1]} as fp, {_top(_P)[0]} as tc, {_top(_P)[1]} as tp from {_PAGES}))"
)
def hybrid_decisions(spark, d):
    s = _structured(spark, d)
    arrays = [F.array(*[F.expr(p) for p in ps]) for ps in (_P, _Q)]
    return s.withColumn("v", scoring.decide(F.lit("https://site.example.com/a"), *arrays, F.col("s"), _CLASSES)).select("doc_id", "v.category", "v.confidence", "v.reason")


@query("select doc_id, doc_id % 5 in (1, 2) as cipher from documents")
def glyph_ciphers(spark, d):
    made = F.expr(r"case doc_id % 5 when 0 then repeat('plain words ', 20) when 1 then repeat('一丁丂七', 50) when 2 then repeat('абв ', 40) when 3 then repeat('一', 60) else concat(repeat('абв ', 40), 'a1') end")
    return table(spark, d, "documents").select("doc_id", detect.is_glyph_cipher(made, F.lit("en-US")).alias("cipher"))


@query("select doc_id, doc_id % 4 in (1, 2) as is_app from documents")
def svg_apps(spark, d):
    body = F.expr("""case doc_id % 4 when 0 then '<svg><foreignObject></foreignObject></svg>' when 1 then '<svg:foreignObject/><script>x</script>' when 2 then '<foreignObject ><script type="text/javascript">x</script>' else '<foreignObject><script type="application/json">x</script>' end""")
    return table(spark, d, "documents").select("doc_id", detect.is_svg_app(F.lit("main_frame"), F.lit("image/svg+xml; charset=utf-8"), body).alias("is_app"))


@query("select doc_id, doc_id % 3 = 0 as bare from documents")
def bare_headers(spark, d):
    headers = F.expr("array(named_struct('name', 'Accept'), named_struct('name', case when doc_id % 3 = 0 then 'X-Bare-Host' else 'X-Host' end))")
    return table(spark, d, "documents").select("doc_id", detect.has_bare_header(headers).alias("bare"))


def _tag(name):
    return f"len(regexp_extract_all(lower(html), '<{name}[\\s>/]'))::int as tag_{name}"


@query(f"select page_id, {', '.join(map(_tag, ('div', 'a', 'script', 'img', 'form', 'iframe')))} from pages")
def page_structure(spark, d):
    return page_features(table(spark, d, "pages")).select("page_id", *[f"tag_{t}" for t in ("div", "a", "script", "img", "form", "iframe")])


@query()
def page_features_all(spark, d):
    f = page_features(table(spark, d, "pages"))
    return f.withColumn("n_links", F.size("links")).drop("links", "script_hosts")


def _flag(pattern: str) -> str:
    return f"regexp_matches(html, '{pattern}')"


@query(
    "select page_id, regexp_extract_all(html, '<[a-zA-Z]').len() as dom_node_count, regexp_extract_all(html, '<a href=').len() as link_count, least(200, list_unique(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))) as n_links, "
    "regexp_extract_all(html, '<input').len() as input_count, regexp_extract_all(html, '<button').len() as button_count, regexp_extract_all(html, '<select').len() as select_count, regexp_extract_all(html, '<form').len() as form_count, "
    "regexp_extract_all(html, '<iframe').len() as iframe_count, regexp_extract_all(html, 'type=\"password\"').len() as password_field_count, 0.0::double as canvas_area_fraction, false as has_dominant_canvas, 0 as iframe_cross_origin_count, "
    "false as has_large_xorigin_iframe, 1.0::double as inline_script_ratio, 0.0::double as third_party_script_ratio, 0.0::double as script_host_entropy, "
    f"{_flag('<video')} as has_video_player, 1.0::double as internal_link_ratio, 0 as outbound_domain_diversity, regexp_extract_all(html, '<img').len()::double as images from pages"
)
def page_record(spark, d):
    f = page_features(table(spark, d, "pages"))
    counts = ["dom_node_count", "link_count", "input_count", "button_count", "select_count", "form_count", "iframe_count", "password_field_count", "canvas_area_fraction", "has_dominant_canvas", "iframe_cross_origin_count", "has_large_xorigin_iframe", "inline_script_ratio", "third_party_script_ratio", "script_host_entropy", "has_video_player", "internal_link_ratio", "outbound_domain_diversity"]
    return f.select("page_id", *counts, F.size("links").alias("n_links"), F.col("tag_img").cast("double").alias("images"))


# ---- metrics -----------------------------------------------------------------

_LABELS = ["adult", "clean", "gambling", "games"]


@query(
    f"select label, case when predicted > 0 then tp / predicted::double else 0.0 end as precision, case when support > 0 then tp / support::double else 0.0 end as recall, support from "
    f"(select label, count(*) filter (y_true = label and y_pred = label) as tp, count(*) filter (y_pred = label) as predicted, count(*) filter (y_true = label) as support from ({TRUTH}), unnest({_LABELS}) as u(label) group by label)"
)
def per_class_metrics(spark, d):
    return metrics.per_class(standin(spark, d, TRUTH), _LABELS)


@query(f"select count(*) filter (y_pred <> 'clean') / count(*)::double as fp_rate from ({TRUTH}) where y_true = 'clean'")
def fp_rate_on_clean(spark, d):
    return metrics.fp_rate(standin(spark, d, TRUTH), "clean")


def _measure_sql():
    out = ["count(*) as n", "count(*) filter (y_true = 'clean') as clean_total", "count(*) filter (y_true = 'clean' and y_pred <> 'clean') as clean_fp"]
    for c in ("adult", "gambling"):
        out += [f"count(*) filter (y_true = '{c}') as total_{c}", f"count(*) filter (y_true = '{c}' and y_pred <> 'clean') as detected_{c}", f"count(*) filter (y_true = '{c}' and y_pred = '{c}') as exact_{c}", f"count(*) filter (y_pred = '{c}') as predicted_{c}"]
    out.append("count(*) filter (y_true <> 'clean' and y_pred <> 'clean' and y_pred <> y_true) as wrong_category")
    more = []
    for c in ("adult", "gambling"):
        more += [f"detected_{c} / greatest(1, total_{c})::double as recall_{c}", f"exact_{c} / greatest(1, total_{c})::double as exact_recall_{c}", f"exact_{c} / greatest(1, predicted_{c})::double as precision_{c}"]
    more.append("clean_fp / greatest(1, clean_total)::double as clean_fp_rate")
    return f"select *, {', '.join(more)} from (select {', '.join(out)} from ({TRUTH}))"


@query(_measure_sql())
def measure_bundle(spark, d):
    return metrics.measure(standin(spark, d, TRUTH), ["adult", "gambling"])


_SWEEP = "select threshold, count(*) filter (y_true = 'clean' and confidence >= threshold) / greatest(1, count(*) filter (y_true = 'clean'))::double as fp_rate, count(*) filter (y_true <> 'clean' and confidence >= threshold) / greatest(1, count(*) filter (y_true <> 'clean'))::double as recall from ({t}), unnest([{x}]) as u(threshold) group by threshold"


@query(_SWEEP.format(t=TRUTH, x=", ".join(f"{x}::double" for x in metrics.TREE_THRESHOLDS)))
def threshold_sweep(spark, d):
    return metrics.sweep(standin(spark, d, TRUTH), metrics.TREE_THRESHOLDS)


@query("select * from (" + _SWEEP.format(t=TRUTH, x=", ".join(f"{x!r}::double" for x in metrics.budget_thresholds())) + ") where fp_rate <= 0.5 or threshold > 0.9949 order by (fp_rate <= 0.5) desc, recall desc, threshold limit 1")
def recall_at_budget(spark, d):
    return metrics.recall_at_fp(standin(spark, d, TRUTH), 0.5)


@query(
    f"with c as (select label, count(*) filter (y_true = label and y_pred = label) as tp, count(*) filter (y_pred = label) as predicted, count(*) filter (y_true = label) as support from ({TRUTH}), unnest(['adult', 'clean', 'gambling']) as u(label) group by label), "
    "p as (select tp / greatest(1, predicted)::double as pr, tp / greatest(1, support)::double as re from c) "
    f"select round((select avg((y_true = y_pred)::int::double) from ({TRUTH})), 9) as accuracy, round(avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end), 9) as macro_f1 from p"
)
def accuracy_and_f1(spark, d):
    return metrics.macro_f1(standin(spark, d, TRUTH), ["adult", "clean", "gambling"]).select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"select prefix, count(*) as n, count(*) filter (y_true = y_pred) as right from (select *, row_number() over (order by doc_id) as i from ({TRUTH})), unnest([10, 50, 200]) as u(prefix) where i <= prefix group by prefix")
def learning_prefixes(spark, d):
    rows = metrics.growing_prefixes(standin(spark, d, TRUTH), (10, 50, 200), "doc_id")
    return rows.groupBy(F.col("prefix").cast("int").alias("prefix")).agg(F.count("*").alias("n"), F.sum((F.col("y_true") == F.col("y_pred")).cast("long")).alias("right"))


@query("with e as (select 'p' || s_suppkey as file, 'c' || (s_suppkey % 3) as b, s_suppkey % 2 = 0 as p from supplier), o as (select 'p' || s_suppkey as file, 'c' || (s_suppkey % 3) as b2, s_suppkey % 5 <> 0 as p2 from supplier where s_suppkey % 7 <> 0) select file, coalesce(b = b2 and p = p2, false) as ok from e left join o using (file)")
def verdict_comparison(spark, d):
    s = table(spark, d, "supplier").withColumn("file", F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))).withColumn("block", F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")))
    return metrics.compare_verdicts(s.withColumn("pin", F.col("s_suppkey") % 2 == 0), s.where("s_suppkey % 7 <> 0").withColumn("pin", F.col("s_suppkey") % 5 != 0))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the category of the list that covers their host."""
    pages = page_hosts(spark, d)
    blocked = pages.select("host").distinct().select(F.col("host").alias("domain"), (F.length("host") % 5).cast("int").alias("cat"), F.lit(0).alias("src"), F.lit(0).cast("long").alias("seq"))
    hit = lookup.longest_listed(pages, lists.tail_table(blocked.where("cat < 4")))
    return pages.join(hit, "host", "left").groupBy(F.coalesce("cat", F.lit(-1)).alias("cat")).agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
