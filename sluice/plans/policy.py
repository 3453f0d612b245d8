"""Decisions on navigations and scanned pages, cheapest tests first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.detect import is_glyph_cipher, works_as
from sluice.functions.urls import hostname, is_search_page, looks_like_proxy_url, pathname
from sluice.operators.lookup import covered, longest_listed


def _flag(df: DataFrame, hosts: DataFrame, name: str) -> DataFrame:
    return df.join(hosts.withColumn(name, F.lit(True)), "host", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def navigation_verdicts(navigations: DataFrame, tail: DataFrame, allow: DataFrame, block: DataFrame, pins: DataFrame, no_pin: DataFrame) -> DataFrame:
    """`navigations` (url, frame: 0 for the top) with action, category and source.

    A proxy URL is blocked in any frame; other frames pass.  Then an allowed host
    passes, and one that the policy, a pin or the list covers is blocked, in that order;
    pins of hosts that are never pinned do not count.  Hosts are looked up once each.
    """
    rows = navigations.withColumn("host", hostname("url"))
    hosts = rows.select("host").distinct()
    listed = longest_listed(hosts, tail).select("host", F.col("cat").alias("list_cat"))
    # a pin is looked up like a listed domain, by its host or a host above
    good = pins.join(covered(pins.select("host"), no_pin.select(F.col("host").alias("domain"))), "host", "left_anti")
    pinned = longest_listed(hosts, good.select(F.col("host").alias("domain"), F.col("category").alias("cat")), hashed=False).select("host", F.col("cat").alias("pin_cat"))
    rows = _flag(_flag(rows, covered(hosts, allow), "allowed"), covered(hosts, block), "denied").join(pinned, "host", "left").join(listed, "host", "left")
    proxy = looks_like_proxy_url("url")
    top = F.col("frame") == 0
    out = lambda action, category, source: F.struct(F.lit(action).alias("action"), category.alias("category"), F.lit(source).alias("source"))
    none = F.lit(None).cast("string")
    verdict = (
        F.when(proxy, out("block", F.lit("proxy-bypass"), "proxy"))
        .when(~top | F.col("host").isNull() | F.col("allowed"), out("allow", none, None))
        .when(F.col("denied"), out("block", F.lit("district-policy"), "district-policy"))
        .when(F.col("pin_cat").isNotNull(), out("block", F.col("pin_cat"), "model"))
        .when(F.col("list_cat").isNotNull(), out("block", F.col("list_cat").cast("string"), "list"))
        .otherwise(out("allow", none, None))
    )
    return rows.withColumn("v", verdict).select(*navigations.columns, "host", "v.action", "v.category", "v.source")


def scan_verdicts(scans: DataFrame, allow: DataFrame, decision: Column, *, model: bool = True) -> DataFrame:
    """`scans` (url, real_host, frame, text, lang, structural, ...) with action, category, source and pin.

    The host is the tab's last real one where the page has none.  Allowed hosts pass;
    then text in a glyph cipher is blocked as a proxy's; then, but on a search engine's
    own pages, the model decides.  A block in the top frame pins the host if the page
    works as what it is blocked for.
    """
    rows = scans.withColumn("host", F.coalesce(hostname("url"), F.col("real_host")))
    rows = _flag(rows, covered(rows.select("host").distinct(), allow), "allowed").withColumn("d", decision)
    top = F.col("frame") == 0
    search = top & is_search_page(hostname("url"), pathname("url"))
    cipher = is_glyph_cipher(F.col("text"), F.col("lang"))
    blocked = F.col("d").isNotNull() & (F.col("d.category") != "clean") if model else F.lit(False)
    category = F.when(F.col("allowed"), None).when(cipher, "proxy-bypass").when(~search & blocked, F.col("d.category"))
    rows = rows.withColumn("category", category)
    return rows.select(
        *scans.columns,
        "host",
        F.when(F.col("category").isNull(), "allow").otherwise("block").alias("action"),
        "category",
        F.when(F.col("category").isNotNull(), "model").alias("source"),
        F.coalesce(top & F.col("category").isNotNull() & works_as(F.col("category"), F.col("structural")), F.lit(False)).alias("pin"),
    )


def network_blocks(errors: DataFrame, tail: DataFrame, block: DataFrame) -> DataFrame:
    """Failed top-level navigations (url, frame, error) that the rules stopped, with the category that covers the host."""
    rows = errors.where((F.col("frame") == 0) & (F.col("error") == "net::ERR_BLOCKED_BY_CLIENT")).withColumn("host", hostname("url")).where("host is not null")
    hosts = rows.select("host").distinct()
    rows = _flag(rows, covered(hosts, block), "denied").join(longest_listed(hosts, tail).select("host", "cat"), "host", "left")
    category = F.when(F.col("denied"), "district-policy").otherwise(F.coalesce(F.col("cat").cast("string"), F.lit("uncategorized")))
    return rows.select(*errors.columns, "host", category.alias("category"), F.when(F.col("denied"), "district-policy").otherwise("list").alias("source"))
