"""Page records with a typed structure, and what is known of a corpus of them: progress by label, domains, what to try next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import html, text, urls
from sluice.operators.corpus import is_usable, remaining

FLOATS = (*html.FLOATS, "url_digit_ratio", "host_entropy", "path_entropy")
FLAGS = (*html.FLAGS, "url_embeds_url")


def typed_structure(value: Callable[[str], Column], ints: tuple[str, ...], hosts: Column) -> Column:
    """A struct of all structural fields, each of its type: what is missing or no number is 0, no truth value false, no list empty."""
    flag = lambda n: F.coalesce(value(n).try_cast("boolean"), value(n).try_cast("double") != 0, F.lit(False))
    fields = [text.coerced_double(value(n)).alias(n) for n in FLOATS] + [text.coerced_int(value(n)).alias(n) for n in ints] + [flag(n).alias(n) for n in FLAGS]
    return F.struct(*fields, F.coalesce(hosts, F.array().cast("array<string>")).alias("script_hosts"))


def structure_of_page(url: Column, features: list[str]) -> Column:
    """The structure of a row of `page_features`, with the features of its URL."""
    lexical = {n: c.cast("double" if n in FLOATS else "int") for n, c in urls.lexical_features(url).items()}
    own = {n: F.col(n) for n in features} | lexical | {"url_embeds_url": urls.looks_like_proxy_url(url)}
    ints = tuple(n for n in own if n not in (*FLOATS, *FLAGS))
    return F.struct(*[own[n].alias(n) for n in (*FLOATS, *ints, *FLAGS)], F.col("script_hosts"))


def build_records(pages: DataFrame, label: Column, id_col: str = "page_id") -> DataFrame:
    """(id, etld1, url, label, text, title, meta, structural) of pages (id, url, html)."""
    found = html.page_features(pages, id_col)
    plain = lambda c: F.trim(text.without_data_uris(F.coalesce(F.col(c), F.lit(""))))
    features = [n for n in (*html.FLOATS, *html.INTS, *html.FLAGS)]
    rows = found.select(id_col, "url", label.alias("label"), text.record_text("text").alias("text"), plain("title").alias("title"), plain("meta").alias("meta"), structure_of_page(F.col("url"), features).alias("structural"), urls.hostname("url").alias("__page_host"))
    return urls.registrable_domain(rows, "__page_host", "etld1").select(id_col, "etld1", "url", "label", "text", "title", "meta", "structural")


def kept_by_label(records: DataFrame) -> DataFrame:
    """(label, kept): usable records of each label."""
    return records.where(is_usable(F.col("title"), F.col("meta"), F.col("text"))).groupBy("label").agg(F.count("*").alias("kept"))


def kept_domains(records: DataFrame) -> DataFrame:
    """(domain) of every record, usable or not."""
    return records.where("url is not null and url <> ''").select(urls.domain_of_url("url").alias("domain")).distinct()


def next_attempts(pool: DataFrame, attempted: DataFrame, records: DataFrame, target: int, batch: int) -> DataFrame:
    """(label, domain, pos): of labels with fewer than `target` usable records, the next `batch` domains of the pool that were neither tried nor kept."""
    open_labels = pool.select("label").distinct().join(kept_by_label(records), "label", "left").where(F.coalesce("kept", F.lit(0)) < target).select("label")
    rest = remaining(pool, attempted, kept_domains(records)).join(open_labels, "label", "left_semi")
    return rest.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("pos"))).where(F.col("n") <= batch).select("label", "domain", "pos")


def fill(pool: DataFrame, read: Callable[[], tuple[DataFrame, DataFrame]], attempt: Callable[[DataFrame], None], target: int, batch: int) -> int:
    """Rounds of attempts until every label has `target` records or its pool is used up; `read` gives what was attempted and recorded so far, `attempt` adds to both."""
    rounds = 0
    while True:
        attempted, records = read()
        chosen = next_attempts(pool, attempted, records, target, batch)
        if not chosen.limit(1).count():
            return rounds
        attempt(chosen)
        rounds += 1
