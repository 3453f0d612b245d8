"""Whole plans: compiling lists, and preparing a training corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import whole_document
from sluice.operators import corpus, lists
from sluice.operators.rank import numbered
from sluice.plans.session import stored


@dataclass
class Compiled:
    table: DataFrame
    tier: DataFrame
    rules: DataFrame
    tail: DataFrame


def compile_lists(rows: DataFrame, *, block: DataFrame | None = None, allow: DataFrame | None = None, ranks: DataFrame | None = None, custom: int = 0, max_domains: int = 500_000, max_rules: int = 28_000, domains_per_rule: int = 60, rules_per_chunk: int = 500) -> Compiled:
    """From (domain, cat, src, seq) rows of all sources to the table, its first tier, rules and hash-sorted tail; an empty table is an error."""
    table = lists.first_wins(rows)
    if block is not None:
        table = lists.add_missing(table, block, custom)
    if allow is not None:
        table = lists.without_allowed(table, allow)
    table = stored(lists.without_covered(stored(table)))
    if not table.limit(1).count():
        raise ValueError("no domains: an empty list is not published")
    tier = lists.first_tier(table, ranks, min(max_domains, max_rules * domains_per_rule))
    tier = stored(numbered(tier, *map(F.col, ("rank", "cat", "src", "seq", "domain")), name="pos"))
    return Compiled(table, tier, lists.pack_rules(tier.select("pos", "domain"), domains_per_rule=domains_per_rule, rules_per_chunk=rules_per_chunk, max_rules=max_rules), lists.tail_table(table))


def prepare(records: DataFrame, *, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), clean: str = "clean", seed: int = 0) -> DataFrame:
    """Records (seq, etld1, url, label, title, meta, text) that are usable, first of their near-duplicates within a label and not contaminated, with their split."""
    doc = whole_document(F.col("title"), F.col("meta"), F.col("text"))
    good = stored(records.where(corpus.is_usable(F.col("title"), F.col("meta"), F.col("text"))).withColumn("doc", doc))
    kept = corpus.without_near_duplicates(good, "seq", "label", "doc")
    kept = corpus.with_contamination(kept, clean).where("contamination is null").drop("contamination", "doc", "simhash")
    return corpus.split_by_key(kept, "etld1", ratios, seed)
