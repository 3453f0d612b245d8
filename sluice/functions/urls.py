"""Domains and URLs as native column expressions: no Python on the executors."""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
_DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]{0,61}[a-z0-9]$"
_HOSTS_ADDRESS = r"^(0\.0\.0\.0|127\.0\.0\.1|::1?|255\.255\.255\.255)\s+"

# Hosts and result-page paths of search engines.
SEARCH_ENGINES = (
    (("google.com", "www.google.com"), ("/", "/search")),
    (("bing.com", "www.bing.com"), ("/", "/search")),
    (("duckduckgo.com",), ("/", "/html", "/lite")),
    (("search.brave.com",), ("/", "/search")),
    (("startpage.com", "www.startpage.com"), ("/", "/sp/search", "/do/search", "/do/dsearch")),
    (("ecosia.org", "www.ecosia.org"), ("/", "/search")),
    (("search.yahoo.com",), ("/", "/search")),
    (("yandex.com", "www.yandex.com"), ("/", "/search")),
)
# Cheap top-level domains, and words in URLs by category.
CHEAP_TLDS = ("xyz", "top", "click", "club", "online", "site", "live", "fun", "gq", "cf", "ml", "tk", "ga", "buzz", "rest", "cyou")
URL_WORDS = {
    "kw_url_proxy": ("proxy", "unblock", "unblocked", "bypass", "vpn", "hidester", "croxy"),
    "kw_url_gambling": ("casino", "bet", "slot", "poker", "gambl", "wager", "roulette", "blackjack"),
    "kw_url_adult": ("porn", "xxx", "sex", "adult", "nude", "cam", "escort", "hentai"),
    "kw_url_games": ("game", "play", "unblocked", "io", "arcade", "html5"),
}
# Platforms whose subdomains are other people's sites, and top-level domains of throw-away proxies.
PLATFORMS = (
    "amazonaws.com", "vercel.app", "workers.dev", "pages.dev", "netlify.app", "onrender.com", "cloudflare.net", "cloudflare.com",
    "fastly.net", "jsdelivr.net", "unpkg.com", "surge.sh", "github.io", "githubusercontent.com", "herokuapp.com", "web.app",
    "firebaseapp.com", "gstatic.com", "googleapis.com", "plesk.page", "ipv64.net", "camdvr.org",
)
PROXY_TLDS = ("lol", "top", "lat", "rest", "space", "gq", "cc", "vc", "best", "games", "pro", "site", "fun", "wtf", "pm")


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _punycode(host: str | None) -> str | None:
    try:
        return host.encode("idna").decode() if host else None
    except UnicodeError:
        return None


def normalize_domain(raw: Column | str, idn: bool = False) -> Column:
    """The bare domain of a line of a plain or hosts list; null for comments, addresses and what is no domain.

    `idn` turns non-ASCII names to punycode, in Python, for those rows alone; without
    it they are null.
    """
    line = F.lower(F.regexp_replace(_c(raw), r"(?U)^\s+|\s+$", ""))
    host = F.regexp_replace(line, _HOSTS_ADDRESS, "")
    host = F.regexp_extract(host, r"^([^\s#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^\*\.", ""), r"\.$", ""), r"^www\.", "")
    if idn:
        host = F.when(host.rlike(r"[^\x00-\x7f]"), F.udf(_punycode, "string")(host)).otherwise(host)
    refused = line.startswith("#") | line.startswith("!") | host.isin("", "localhost", "broadcasthost") | host.rlike(IPV4) | ~host.rlike(_DOMAIN)
    return F.when(~refused, host)


def domain_suffixes(host: Column | str) -> Column:
    """All suffixes of at least two labels, longest first; an address stands for itself; empty without a dot."""
    h = F.regexp_replace(F.lower(_c(host)), r"\.$", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    return F.when(h.isNull() | ~h.contains("."), F.array().cast("array<string>")).when(h.rlike(IPV4) | h.startswith("["), F.array(h)).otherwise(every)


def ancestors(host: Column | str) -> Column:
    """The proper suffixes among `domain_suffixes`."""
    return F.filter(domain_suffixes(host), lambda x: x != F.regexp_replace(F.lower(_c(host)), r"\.$", ""))


def last_two_labels(host: Column | str) -> Column:
    labels = F.filter(F.split(F.lower(_c(host)), r"\."), lambda x: x != "")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def hostname(url: Column | str) -> Column:
    """Lower-case host of an http or https URL; null otherwise."""
    u = _c(url)
    return F.when(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https"), F.lower(F.try_parse_url(u, F.lit("HOST"))))


def pathname(url: Column | str) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(_c(url), F.lit("PATH")), F.lit("")), F.lit("/"))


def query_string(url: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(_c(url), F.lit("QUERY")), F.lit(""))


def domain_of_url(url: Column | str) -> Column:
    """Without a leading https:// and then http://, and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(url), r"^https://", ""), r"^http://", ""), r"/+$", "")


def entropy(text: Column | str) -> Column:
    """Shannon entropy in bits of the characters; 0 for empty text."""
    t = _c(text)
    chars = F.filter(F.split(t, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x))))


def count_present(text: Column, words: tuple[str, ...]) -> Column:
    """How many of `words` occur in the text at all."""
    return sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int"))


def lexical_features(url: Column | str) -> dict[str, Column]:
    """Fifteen features of the URL string alone."""
    u = _c(url)
    host, path = F.coalesce(F.lower(F.try_parse_url(u, F.lit("HOST"))), F.lit("")), pathname(u)
    n = F.length(u)
    parts = lambda s, by: F.size(F.filter(F.split(s, by), lambda x: x != ""))
    out = {
        "url_length": n,
        "path_depth": parts(path, "/"),
        "query_param_count": parts(query_string(u), "&"),
        "url_digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(F.lit(0.0)),
        "url_hyphen_count": F.regexp_count(u, F.lit("-")),
        "url_pct_encoded_count": F.regexp_count(u, F.lit("%[0-9a-fA-F]{2}")),
        "host_entropy": entropy(host),
        "path_entropy": entropy(path),
        "subdomain_depth": F.greatest(F.lit(0), parts(host, r"\.") - 2),
        "is_ip_literal_host": host.rlike(IPV4).cast("int"),
        "is_cheap_tld": host.rlike(r"\.(" + "|".join(CHEAP_TLDS) + ")$").cast("int"),
    }
    return out | {name: count_present(F.lower(u), words) for name, words in URL_WORDS.items()}


def decodes_to_url(segment: Column) -> Column:
    """True if a path segment is a whole http(s) URL in base64, plain or URL-safe."""
    s = F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)
    plain = F.translate(s, "-_", "+/")
    bare = F.regexp_replace(plain, "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    right = (F.length(s) >= 24) & s.rlike(r"^[A-Za-z0-9+/=_-]+$") & decoded.rlike(r"(?i)^https?://") & F.try_parse_url(decoded, F.lit("HOST")).isNotNull()
    return F.coalesce(right, F.lit(False))


def looks_like_proxy_url(url: Column | str) -> Column:
    """The target of a web proxy in the path, percent-encoded or in base64; not as a plain path or query."""
    u = _c(url)
    path = F.try_parse_url(u, F.lit("PATH"))
    low = F.lower(path)
    found = low.contains("https%3a%2f%2f") | low.contains("http%3a%2f%2f") | F.exists(F.split(path, "/"), decodes_to_url)
    return F.coalesce(F.try_parse_url(u, F.lit("HOST")).isNotNull() & found, F.lit(False))


def is_search_page(host: Column | str, path: Column | str) -> Column:
    """A search engine's home or result page: exact host, `/` exactly, other paths with what is below them."""
    h, p = F.lower(_c(host)), F.lower(F.coalesce(_c(path), F.lit("/")))
    every = F.lit(False)
    for hosts, paths in SEARCH_ENGINES:
        under = F.lit(False)
        for s in paths:
            under = under | ((p == "/") if s == "/" else ((p == s) | p.startswith(s + "/")))
        every = every | (h.isin(*hosts) & under)
    return F.coalesce(every, F.lit(False))


def is_search_url(url: Column | str) -> Column:
    return is_search_page(F.lower(F.try_parse_url(_c(url), F.lit("HOST"))), pathname(url))


def matches_suffix(host: Column, domains: Column) -> Column:
    """The first of an array of domains that the host is or lies under; null if none."""
    return F.get(F.filter(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))), F.lit(0))


def hosts_in_text(text: Column | str) -> Column:
    """Lower-case host names in free text, in order, without noise hosts and file names of assets."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"(?i)\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"), F.lit(1)), F.lower)
    noise = r"(^|\.)(discord\.gg|discordapp\.com|unblokkked\.|w3\.org|youtube\.com|youtu\.be)$"
    return F.filter(found, lambda h: ~h.rlike(noise) & ~h.rlike(r"\.(png|jpg|svg|js|css|webp|ico)$"))


@cache
def public_suffixes() -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """Plain, wildcard and exception rules of the public list of registry suffixes, which comes with the package; the driver reads it."""
    plain, wild, exceptions = [], [], []
    for line in files("sluice.functions").joinpath("public_suffixes.txt").read_text("utf-8").splitlines():
        rule = line.strip()
        if rule and not rule.startswith("//"):
            ascii_rule = rule.encode("idna").decode() if not rule.isascii() and not rule.startswith(("*", "!")) else rule
            (wild if rule.startswith("*.") else exceptions if rule.startswith("!") else plain).append(ascii_rule.removeprefix("*.").removeprefix("!"))
    if not (plain and wild and exceptions):
        raise ValueError("the list of public suffixes is empty")
    return tuple(plain), tuple(wild), tuple(exceptions)


def registrable_domain(df: DataFrame, host_col: str, out: str = "etld1") -> DataFrame:
    """`df` with the domain one label below the public suffix of a host; "" for addresses and bare suffixes.

    The suffix rules are a table of some thousand rows, broadcast; each host's suffixes
    are looked up in it, longest first.
    """
    spark: SparkSession = df.sparkSession
    plain, wild, exceptions = public_suffixes()
    # kind 0: exception (the rule itself is registrable), 1: wildcard (one more label belongs to the suffix), 2: plain
    rules = spark.createDataFrame([(r, 2) for r in plain] + [(r, 1) for r in wild] + [(r, 0) for r in exceptions], "rule string, kind int")
    hosts = df.select(F.col(host_col).alias("__host")).distinct()
    h = F.regexp_replace(F.lower("__host"), r"\.$", "")
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    n = F.size(labels)
    named = hosts.where(F.col("__host").isNotNull() & ~h.rlike(IPV4) & ~h.startswith("[") & (n >= 1))
    each = named.select("__host", F.size(labels).alias("n"), labels.alias("labels"), F.explode(F.sequence(F.lit(1), n)).alias("k"))
    each = each.withColumn("rule", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), "."))
    hit = each.join(F.broadcast(rules), "rule")
    # labels of the public suffix; an exception beats the rest, else the longest rule; a host under an unknown suffix has no such domain
    size = F.when(F.col("kind") == 0, F.col("k") - 1).when(F.col("kind") == 1, F.col("k") + 1).otherwise(F.col("k"))
    best = hit.groupBy("__host").agg(F.max(F.when(F.col("kind") == 0, size)).alias("e"), F.max(F.when(F.col("kind") != 0, F.least(size, F.col("n")))).alias("s"))
    sized = named.select("__host", labels.alias("labels"), n.alias("n")).join(best, "__host", "left").withColumn("s", F.coalesce("e", "s"))
    own = sized.select("__host", F.when(F.col("s").isNotNull() & (F.col("n") > F.col("s")), F.array_join(F.slice("labels", F.col("n") - F.col("s"), F.col("s") + 1), ".")).otherwise("").alias(out))
    return df.join(own, F.col(host_col) == own["__host"], "left").drop("__host").withColumn(out, F.coalesce(out, F.lit("")))
