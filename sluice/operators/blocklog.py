"""Block events: attribution, suppression of repeats, counters, series and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPEAT_MS = 3_000
DOMAINS, EVENTS, DAYS = 5_000, 2_000, 400
OTHER = "(other)"


def _per_tab() -> Window:
    return Window.partitionBy("tab").orderBy("t", "seq")


def logged(events: DataFrame) -> DataFrame:
    """Events (tab, t, seq, domain) without those that follow one of the same tab and domain within three seconds.

    It is the tab's previous event that counts, also if that was itself suppressed.
    """
    w = _per_tab()
    rows = events.withColumn("__d", F.lag("domain").over(w)).withColumn("__t", F.lag("t").over(w))
    return rows.where(F.col("__t").isNull() | ~F.col("__d").eqNullSafe(F.col("domain")) | (F.col("t") - F.col("__t") >= REPEAT_MS)).drop("__d", "__t")


def attributed(events: DataFrame, host: str = "host") -> DataFrame:
    """`events` with real_host: the tab's last host up to and with the event."""
    return events.withColumn("real_host", F.last(host, ignorenulls=True).over(_per_tab().rowsBetween(Window.unboundedPreceding, 0)))


def tabs_on(events: DataFrame, hosts: DataFrame, host: str = "host") -> DataFrame:
    """(tab, host) of tabs whose last host is one of `hosts`: who is to be blocked when a host is."""
    now = events.where(F.col(host).isNotNull()).groupBy("tab").agg(F.max_by(host, F.struct("t", "seq")).alias("host"))
    return now.join(hosts.select(F.col(host).alias("host")).distinct(), "host", "left_semi").select("tab", "host")


def totals(events: DataFrame, by: str) -> DataFrame:
    return events.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("n"))


def capped_domains(events: DataFrame, most: int = DOMAINS) -> DataFrame:
    """(domain, n): the first `most` distinct domains by first event keep their name, all others are one."""
    each = events.groupBy("domain").agg(F.count("*").alias("n"), F.min(F.struct("t", "seq")).alias("first"))
    named = each.orderBy("first", "domain").limit(most).select("domain", F.lit(True).alias("named"))
    kept = each.join(named, "domain", "left")
    return kept.groupBy(F.when(F.col("named"), F.col("domain")).otherwise(OTHER).alias("domain")).agg(F.sum("n").alias("n"))


def utc_day(t_ms: Column) -> Column:
    """yyyy-MM-dd of milliseconds since 1970, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t_ms / 86_400_000).cast("int")).cast("string")


def per_day(events: DataFrame, days: int = DAYS) -> DataFrame:
    """(day, category, n) of the latest `days` days that have events, in UTC."""
    counts = events.groupBy(utc_day(F.col("t")).alias("day"), "category").agg(F.count("*").alias("n"))
    latest = counts.select("day").distinct().orderBy(F.desc("day")).limit(days)
    return counts.join(F.broadcast(latest), "day", "left_semi")


def daily_series(events: DataFrame, until: str, days: int = 30) -> DataFrame:
    """(day, n) of `days` days up to `until` (yyyy-MM-dd), 0 where there is no event."""
    spark = events.sparkSession
    calendar = spark.range(days).select(F.date_sub(F.lit(until).cast("date"), F.col("id").cast("int")).cast("string").alias("day"))
    counts = events.groupBy(utc_day(F.col("t")).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def top(counts: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` largest counts; ties by name."""
    return counts.orderBy(F.desc("n"), F.col(key)).limit(most)


def latest(events: DataFrame, most: int) -> DataFrame:
    """The last `most` events, latest first."""
    return events.orderBy(F.desc("t"), F.desc("seq")).limit(most)


def first_pins(pins: DataFrame, most: int = 2_000) -> DataFrame:
    """(host, category, confidence, t, seq): the first pin of each host; the newest `most` hosts by that."""
    at = F.struct("t", "seq")
    each = pins.groupBy("host").agg(F.min_by(F.struct("category", "confidence", "t", "seq"), at).alias("p")).select("host", "p.*")
    return each.orderBy(F.desc("t"), F.desc("seq")).limit(most)


def rate_limited(requests: DataFrame, gap_ms: int = 60_000) -> DataFrame:
    """Requests (tab, t, seq) with accepted: a gap of `gap_ms` since the last accepted one is needed.

    Which requests count depends on those accepted before, so a tab's times are read in
    order, as a stream: from each accepted one to the first that is far enough from it.
    """
    schema = ", ".join([*(f"`{c}` {t}" for c, t in requests.dtypes), "accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, last = None, None
        for b in batches:
            times = b.column("t").to_numpy(zero_copy_only=False).astype(np.int64)
            runs = pc.run_end_encode(b.column("tab"))
            taken, at = np.zeros(len(times), bool), 0
            for end, own in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if own != tab:
                    tab, last = own, None
                while at < end:
                    at += 0 if last is None else int(np.searchsorted(times[at:end], last + gap_ms))
                    if at < end:
                        taken[at], last, at = True, int(times[at]), at + 1
            yield pa.record_batch([*b.columns, pa.array(taken)], [*b.schema.names, "accepted"])

    return requests.repartition("tab").sortWithinPartitions("tab", "t", "seq").mapInArrow(run, schema)


def report_sections(events: DataFrame) -> dict[str, DataFrame]:
    """The four sections of the report: events, and counts by source, domain and category, largest first."""
    out = {"events": latest(events, EVENTS).select("t", "domain", "category", "source")}
    for by in ("source", "domain", "category"):
        out[by] = totals(events, by).orderBy(F.desc("n"), "key")
    return out
