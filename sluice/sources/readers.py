"""Readers of lists, ranks, records and settings."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sluice.functions.urls import normalize_domain
from sluice.operators.lists import tar_members


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, seq) of a text; seq ascends with the place in the file.  Lines end at \\n only.  A missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string, seq long")
    return spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("seq"))


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain, seq) of the valid lines of a plain or hosts list."""
    return lines(spark, path).select(normalize_domain("value", idn=True).alias("domain"), "seq").where("domain is not null")


def archive_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain, seq) of the members named domains of a .tar.gz; archives are read whole, one per task."""
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(tar_members, "path string, seq long, value string")
    return found.select(normalize_domain("value", idn=True).alias("domain"), "seq").where("domain is not null")


def ordinal_ranks(spark: SparkSession, path: str) -> DataFrame | None:
    """(domain, rank) of a `number,domain` list; the rank is the ordinal among valid lines, the last for a repeated domain; None without the file."""
    if not exists(spark, path):
        return None
    rows = lines(spark, path).select(F.lower(F.trim(F.get(F.split("value", ","), F.lit(1)))).alias("domain"), "seq").where("domain is not null and domain <> ''")
    # ordinals by partition: counts of the partitions before, and the place in its own
    keyed = rows.withColumn("part", F.shiftright("seq", 33))
    before = keyed.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = keyed.join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("seq")))
    return ranked.groupBy("domain").agg(F.max("rank").alias("rank"))


def numbered_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(domain, rank) with the rank as it is written; lines without a whole number are left out, the last of a domain counts."""
    parts = F.split("value", ",", 2)
    rows = lines(spark, path).select(F.trim(F.get(parts, F.lit(1))).alias("domain"), F.trim(F.get(parts, F.lit(0))).try_cast("long").alias("rank"), "seq").where("rank is not null and domain <> ''")
    return rows.groupBy("domain").agg(F.max_by("rank", "seq").alias("rank"))


def commented_list(spark: SparkSession, path: str) -> DataFrame:
    """(host, seq): lower-case lines without what follows a #."""
    return lines(spark, path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("host"), "seq").where("host <> ''")


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """(seed, seq): lines as they are, but for blank ones and those that begin with #."""
    return lines(spark, path).select(F.trim("value").alias("seed"), "seq").where("seed <> '' and not startswith(seed, '#')")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token): distinct white-space separated tokens of a log."""
    return lines(spark, path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("token")).where("token <> ''").distinct()


def labelled_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, label, seq) of lines with a tab, cut at the first one."""
    parts = F.split("value", "\t", 2)
    return lines(spark, path).where(F.col("value").contains("\t")).select(parts[0].alias("domain"), parts[1].alias("label"), "seq")


def json_records(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Records of JSON lines that end at \\n alone; broken ones are left out, or an error if `strict`."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


#: Settings and what they are where a policy does not say.
DEFAULTS = {
    "artifactBaseUrl": "",
    "allowDomains": [],
    "extraBlockDomains": [],
    "noPinDomains": [],
    "syncHours": 12,
    "blockThreshold": None,
    "blockSubframes": True,
    "modelEnabled": True,
    "allowClearLogs": True,
}
_LISTS = ("allowDomains", "extraBlockDomains", "noPinDomains")


def settings(managed: dict | None) -> dict:
    """Defaults with what a policy sets, nulls aside: addresses without a trailing slash, lists trimmed, lower-case and without blanks."""
    out = dict(DEFAULTS) | {k: v for k, v in (managed or {}).items() if v is not None}
    out["artifactBaseUrl"] = str(out["artifactBaseUrl"]).rstrip("/")
    for k in _LISTS:
        out[k] = [x for d in out[k] if (x := str(d).strip().lower())]
    return out


def manifest(spark: SparkSession, path: str) -> dict:
    """The description of a published directory, on any file system that Spark reads."""
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/meta.json").first()[0])


def current(spark: SparkSession, root: str) -> str:
    """The directory of the current version: all its files are of one generation."""
    return f"{root}/{spark.read.option('wholetext', True).text(f'{root}/CURRENT').first()[0].strip()}"


def labelled_urls(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(url, label, seq) of a list of URLs that are all of one label."""
    return lines(spark, path).select(F.trim("value").alias("url"), F.lit(label).alias("label"), "seq").where("url <> ''")


def json_union(spark: SparkSession, schema: StructType | str, *patterns: str, strict: bool = True) -> DataFrame:
    """Records of the files that each pattern names, with origin (which pattern), path and seq, by which they are in order."""
    found = [json_records(spark, p, schema, strict).select("*", F.lit(i).alias("origin"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq")) for i, p in enumerate(patterns)]
    return reduce(DataFrame.unionByName, found)
