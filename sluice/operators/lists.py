"""The list compiler: domains of many sources to one table, its tiers, rules and artifacts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import fnv1a64, unsigned_order
from sluice.functions.urls import ancestors

#: Bytes of a rule before its domains, beside each domain, and at most.
RULE_HEAD, RULE_EACH, RULE_BYTES = 140, 3, 1800


def first_wins(rows: DataFrame) -> DataFrame:
    """(domain, cat, src, seq) of the first row of each domain, by category, source and line."""
    key = F.struct("cat", "src", "seq")
    return rows.where("domain is not null").groupBy("domain").agg(F.min(key).alias("k")).select("domain", "k.cat", "k.src", "k.seq")


def source_counts(rows: DataFrame) -> DataFrame:
    """Parsed domains of each source, and those that no earlier one had."""
    parsed = rows.where("domain is not null").groupBy("cat", "src").agg(F.count("*").alias("parsed"))
    new = first_wins(rows).groupBy("cat", "src").agg(F.count("*").alias("new"))
    return parsed.join(new, ["cat", "src"], "left").select("cat", "src", "parsed", F.coalesce("new", F.lit(0)).alias("new"))


def add_missing(table: DataFrame, block: DataFrame, cat: int) -> DataFrame:
    """`table` with the domains of `block` (domain, seq) that it lacks, as the category `cat`, after all others."""
    more = block.groupBy("domain").agg(F.min("seq").alias("seq")).join(table, "domain", "left_anti")
    return table.unionByName(more.select("domain", F.lit(cat).alias("cat"), F.lit(0).alias("src"), "seq"))


def without_allowed(table: DataFrame, allow: DataFrame) -> DataFrame:
    """`table` without the allowed domains and all below them."""
    lines = table.select("domain", F.explode(F.array_distinct(F.concat(F.array("domain"), ancestors("domain")))).alias("up"))
    gone = lines.join(allow.select(F.col("domain").alias("up")).distinct(), "up", "left_semi").select("domain").distinct()
    return table.join(gone, "domain", "left_anti")


def without_covered(table: DataFrame) -> DataFrame:
    """`table` without the domains that lie below another of the same category."""
    lines = table.select("domain", "cat", F.explode(ancestors("domain")).alias("up"))
    gone = lines.join(table.select(F.col("domain").alias("up"), "cat"), ["up", "cat"], "left_semi").select("domain").distinct()
    return table.join(gone, "domain", "left_anti")


def first_tier(table: DataFrame, ranks: DataFrame | None, capacity: int) -> DataFrame:
    """The best-ranked domains, then the rest in order of category, source and line, up to `capacity`."""
    order = ["cat", "src", "seq", "domain"]
    if ranks is None:
        return table.withColumn("rank", F.lit(None).cast("long")).orderBy(*order).limit(capacity)
    return table.join(ranks.select("domain", F.col("rank").cast("long").alias("rank")), "domain", "left").orderBy(F.col("rank").asc_nulls_last(), *order).limit(capacity)


def tail_table(table: DataFrame) -> DataFrame:
    """(h, cat, domain) of every domain, dealt and sorted by the unsigned hash; a scan by hash prunes row groups."""
    hashed = table.select(fnv1a64("domain").alias("h"), F.col("cat").cast("int").alias("cat"), "domain")
    return hashed.repartitionByRange(unsigned_order("h")).sortWithinPartitions(unsigned_order("h"), "domain")


def collisions(tail: DataFrame) -> DataFrame:
    """Hashes that more than one domain has."""
    return tail.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


def pack_rules(tier: DataFrame, *, domains_per_rule: int = 60, rules_per_chunk: int = 500, max_rules: int = 28_000) -> DataFrame:
    """(pos, domain, chunk, rule_id) of a tier's domains (pos, domain), next-fit in order of pos.

    A rule takes domains up to its number and its bytes.  What a rule takes depends on
    where the one before it ended, so positions are worked through in order: a scan over
    (pos, length) alone, of no more domains than all rules can hold, that hands each
    rule's bounds back to the rows by a join.
    """
    most = -(-max_rules // rules_per_chunk) * rules_per_chunk * domains_per_rule
    sizes = tier.where(F.col("pos") < most).select("pos", F.length("domain").alias("n"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rule, held, used, out = 0, 0, RULE_HEAD, []
        for n in pdf["n"].tolist():
            if held and (held >= domains_per_rule or used + n + RULE_EACH > RULE_BYTES):
                rule, held, used = rule + 1, 0, RULE_HEAD
            held, used = held + 1, used + n + RULE_EACH
            out.append(rule)
        return pd.DataFrame({"pos": pdf["pos"], "rule": out})

    ruled = sizes.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(scan, "pos long, rule long")
    chunk = F.floor(F.col("rule") / rules_per_chunk)
    # chunks begin while their first rule is below the limit, and are then filled
    kept = ruled.where(chunk * rules_per_chunk < max_rules)
    return tier.join(kept, "pos").select("pos", "domain", chunk.cast("int").alias("chunk"), (F.col("rule") + 1).cast("long").alias("rule_id"))


def rule_bodies(packed: DataFrame) -> DataFrame:
    """One row per chunk: file, body (JSON), sha256, first rule id, rules and domains."""
    rules = packed.groupBy("chunk", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "domain"))), lambda x: x["domain"]).alias("domains"))
    rule = F.struct(
        F.col("rule_id").alias("id"),
        F.lit(1).alias("priority"),
        F.struct(F.lit("block").alias("type")).alias("action"),
        F.struct(F.col("domains").alias("requestDomains"), F.array(F.lit("main_frame"), F.lit("sub_frame")).alias("resourceTypes")).alias("condition"),
    )
    chunks = rules.groupBy("chunk").agg(F.array_sort(F.collect_list(rule)).alias("rules"), F.sum(F.size("domains")).alias("domains"))
    body = chunks.withColumn("body", F.to_json("rules"))
    return body.select("chunk", F.concat(F.lpad(F.col("chunk").cast("string"), 3, "0"), F.lit(".json")).alias("file"), "body", F.sha2("body", 256).alias("sha256"), F.col("rules")[0]["id"].alias("rule_id_start"), F.size("rules").alias("rule_count"), "domains")


def label_rows(table: DataFrame, ranks: DataFrame, names: dict[int, str], clean: int = 50_000) -> DataFrame:
    """(domain, label): every blocked domain with its category's name, and the best-ranked domains that are not blocked nor below one, as clean."""
    blocked = table.select("domain", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("cat")).alias("label"))
    lines = ranks.select("domain", "rank", F.explode(F.concat(F.array("domain"), ancestors("domain"))).alias("up"))
    hit = lines.join(table.select(F.col("domain").alias("up")), "up", "left_semi").select("domain").distinct()
    free = ranks.join(hit, "domain", "left_anti").orderBy("rank", "domain").limit(clean)
    return blocked.unionByName(free.select("domain", F.lit("clean").alias("label")))


def policy_rules(allow: list[str], block: list[str], resource_types: tuple[str, ...] = ("main_frame", "sub_frame"), most: int = 5_000) -> list[dict]:
    """Rules of a policy: allowed domains above all else, further blocked ones above the lists."""
    rule = lambda i, priority, action, d, types: {"id": i, "priority": priority, "action": {"type": action}, "condition": {"requestDomains": [d], "resourceTypes": list(types)}}
    allowed = [rule(900_001 + i, 100, "allow", d, ("main_frame", "sub_frame")) for i, d in enumerate(allow[:most])]
    return allowed + [rule(950_001 + i, 2, "block", d, resource_types) for i, d in enumerate(block[:most])]


def changed_chunks(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(file, state): added, changed or stale chunks between two tables (file, sha256); equal ones have no row."""
    a, b = stored.select("file", F.col("sha256").alias("old")), live.select("file", F.col("sha256").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "stale").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "file", "full_outer").select("file", state.alias("state")).where("state is not null")


def tar_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of the members named domains of gzipped archives."""
    import io
    import tarfile

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                for m in tar:
                    if m.isfile() and m.name.endswith("/domains"):
                        lines = tar.extractfile(m).read().decode("utf-8", "replace").split("\n")
                        yield pd.DataFrame({"path": path, "seq": range(len(lines)), "value": lines})
