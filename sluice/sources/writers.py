"""Writers of list artifacts, splits and reports.  A directory is written anew and named last, never in place."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import unsigned_order
from sluice.operators import blocklog


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, body: str | bytes) -> None:
    """One small file, through Hadoop's file systems, renamed into place."""
    data = body.encode() if isinstance(body, str) else body
    fs, p = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(data))
    out.close()
    # in one step: a reader finds the old file or the new one
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(p), options)


def rule_chunks(spark: SparkSession, bodies: DataFrame, path: str) -> list[dict]:
    """NNN.json of every chunk; returns their descriptions.  Their number is bounded by the tier's rules."""
    out = []
    for r in bodies.orderBy("chunk").toLocalIterator():
        write_text(spark, f"{path}/{r['file']}", r["body"])
        out.append({"file": r["file"], "sha256": r["sha256"], "ruleIdStart": r["rule_id_start"], "ruleCount": r["rule_count"], "domains": r["domains"]})
    return out


def tail(table: DataFrame, path: str) -> None:
    """The hash-sorted table as Parquet, sorted over all files."""
    table.select("h", "cat").write.parquet(path)


def tail_binary(table: DataFrame) -> tuple[bytes, bytes]:
    """Hashes (little-endian, unsigned order) and categories of a table that fits one file, as devices read them."""
    hashes, cats = bytearray(), bytearray()
    for r in table.orderBy(unsigned_order("h")).select("h", "cat").toLocalIterator():
        hashes += struct.pack("<q", r["h"])
        cats.append(r["cat"])
    return bytes(hashes), bytes(cats)


def content_version(table: DataFrame, categories: list[str], chunks: list[dict]) -> str:
    """Sixteen digits of what is published: hashes of ranges of the table in order, categories and chunks; equal contents have equal ones."""
    ordered = table.select("h", "cat").withColumn("range", F.shiftrightunsigned("h", 52))
    # 4096 ranges of hashes, each digested where it lies
    parts = ordered.groupBy("range").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat(F.lpad(F.hex("h"), 16, "0"), F.lit(":"), F.col("cat").cast("string"))))), 256).alias("d")).orderBy("range")
    digest = hashlib.sha256()
    for r in parts.toLocalIterator():
        digest.update(f"{r['range']}:{r['d']}".encode())
    digest.update(json.dumps({"categories": categories, "chunks": chunks}, separators=(",", ":")).encode())
    return digest.hexdigest()[:16]


def labels(rows: DataFrame, path: str) -> None:
    """domain<TAB>label."""
    rows.select("domain", "label").write.option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def splits(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder per split."""
    rows.write.partitionBy("split").json(path)


def quarantine(rows: DataFrame, path: str) -> bool:
    """Kept and quarantined rows (by the column contamination) beside each other in a new directory; nothing if none is quarantined."""
    if not rows.where("contamination is not null").limit(1).count():
        return False
    rows.where("contamination is null").drop("contamination").write.json(f"{path}/kept")
    rows.where("contamination is not null").write.json(f"{path}/quarantined")
    return True


def commit(spark: SparkSession, root: str, version: str, meta: dict) -> None:
    """Make `root/version` current: its description first, then the one small file that names it."""
    write_text(spark, f"{root}/{version}/meta.json", json.dumps(meta | {"version": version}, ensure_ascii=False))
    write_text(spark, f"{root}/CURRENT", version)


def report_csv(events: DataFrame, path: str) -> None:
    """Four tables: events, by source, by domain, by category, every value quoted, quotes doubled."""
    for name, section in blocklog.report_sections(events).items():
        section.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/{name}")


def report_json(events: DataFrame, exported: str) -> DataFrame:
    """One row, json: when, counts by category and source, and the recent events."""
    counts = lambda by: blocklog.totals(events, by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(f"by_{by}"))
    recent = blocklog.latest(events, 50).agg(F.sort_array(F.collect_list(F.struct("t", "seq", "domain", "category", "source")), asc=False).alias("recentEvents"))
    total = events.agg(F.count("*").alias("total"))
    one = total.join(counts("category")).join(counts("source")).join(recent)
    return one.select(F.to_json(F.struct(F.lit(exported).alias("exported"), F.struct("total", F.col("by_category").alias("byCategory"), F.col("by_source").alias("bySource")).alias("stats"), "recentEvents")).alias("json"))


def append_log(batch: DataFrame, path: str) -> None:
    """Rows added to a log; a killed writer leaves whole files or none."""
    batch.write.mode("append").json(path)


def seed_urls(rows: DataFrame, most: int = 250) -> DataFrame:
    """(topic, url, pos): distinct in first order, at most `most` of a topic."""
    from pyspark.sql.window import Window

    one = rows.groupBy("topic", "url").agg(F.min("seq").alias("seq"))
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("topic").orderBy("seq", "url"))).where(F.col("pos") <= most).select("topic", "url", "pos")
