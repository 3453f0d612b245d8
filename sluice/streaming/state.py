"""Stateful operators over streams of navigation, scan and block events, keyed by tab or host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sluice.operators.blocklog import REPEAT_MS, utc_day

_EVENT = "tab long, t long, seq long, domain string, category string, source string"


class _Logged(StatefulProcessor):
    """Passes events but for those within three seconds of the tab's previous one of the same domain."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "domain string, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "seq"])
        domain, t = self.last.get() if self.last.exists() else (None, None)
        keep = []
        for d, at in zip(pdf["domain"], pdf["t"].tolist(), strict=True):
            keep.append(t is None or d != domain or at - t >= REPEAT_MS)
            domain, t = d, at
        self.last.update((domain, int(t)))
        yield pdf[keep]

    def close(self) -> None:
        pass


class _Attributed(StatefulProcessor):
    """Adds the tab's last real host; a closed tab forgets it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.host = handle.getValueState("host", "host string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "seq"])
        host = self.host.get()[0] if self.host.exists() else None
        out = []
        for kind, h in zip(pdf["kind"], pdf["host"], strict=True):
            if kind == "closed":
                host = None
            elif isinstance(h, str) and h:
                host = h
            out.append(host)
        if host is None:
            self.host.clear()
        else:
            self.host.update((host,))
        yield pdf.assign(real_host=pd.Series(out, index=pdf.index, dtype=object))[pdf["kind"] != "closed"]

    def close(self) -> None:
        pass


class _FirstPins(StatefulProcessor):
    """The first pin of each host; later ones change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pin = handle.getValueState("pin", "category string, confidence double, t long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "seq"])
        if not self.pin.exists():
            r = pdf.iloc[0]
            self.pin.update((r["category"], float(r["confidence"]), int(r["t"]), int(r["seq"])))
            yield pdf.iloc[:1][["host", "category", "confidence", "t", "seq"]]

    def close(self) -> None:
        pass


class _Throttled(StatefulProcessor):
    """Scans a page at most so often: same payloads are skipped, a cooldown lies between scans, a page has a limit."""

    def __init__(self, cooldown_ms: int, most: int):
        self.cooldown, self.most = cooldown_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "signature string, t long, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "seq"])
        signature, t, n = self.state.get() if self.state.exists() else (None, None, 0)
        keep = []
        for s, at in zip(pdf["signature"], pdf["t"].tolist(), strict=True):
            ok = n < self.most and s != signature and (t is None or at - t >= self.cooldown)
            keep.append(ok)
            if ok:
                signature, t, n = s, at, n + 1
        if t is not None:
            self.state.update((signature, int(t), int(n)))
        yield pdf[keep]

    def close(self) -> None:
        pass


class _RateLimited(StatefulProcessor):
    """Requests since the last accepted one of the key that lie far enough."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "seq"])
        t = self.last.get()[0] if self.last.exists() else None
        out = []
        for at in pdf["t"].tolist():
            ok = t is None or at - t >= self.gap
            out.append(ok)
            t = at if ok else t
        self.last.update((int(t),))
        yield pdf.assign(accepted=out)

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def logged(events: DataFrame) -> DataFrame:
    """Streaming twin of `blocklog.logged`."""
    return _run(events.select("tab", "t", "seq", "domain", "category", "source"), "tab", _Logged(), _EVENT)


def attributed(events: DataFrame) -> DataFrame:
    """Events (tab, t, seq, kind, host) with real_host; kind `closed` ends a tab."""
    return _run(events.select("tab", "t", "seq", "kind", "host"), "tab", _Attributed(), "tab long, t long, seq long, kind string, host string, real_host string")


def first_pins(pins: DataFrame) -> DataFrame:
    return _run(pins.select("host", "category", "confidence", "t", "seq"), "host", _FirstPins(), "host string, category string, confidence double, t long, seq long")


def throttled(scans: DataFrame, cooldown_ms: int = 4_000, most: int = 12) -> DataFrame:
    """Scans (page, t, seq, signature) that are let through."""
    return _run(scans.select("page", "t", "seq", "signature"), "page", _Throttled(cooldown_ms, most), "page string, t long, seq long, signature string")


def rate_limited(requests: DataFrame, gap_ms: int = 60_000) -> DataFrame:
    """Streaming twin of `blocklog.rate_limited`."""
    return _run(requests.select("tab", "t", "seq"), "tab", _RateLimited(gap_ms), "tab long, t long, seq long, accepted boolean")


def counters(events: DataFrame) -> DataFrame:
    """Running counts by UTC day, category and source, for update mode."""
    return events.groupBy(utc_day(F.col("t")).alias("day"), "category", "source").agg(F.count("*").alias("n"))


def windowed_counters(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by window and category with bounded state: events later than `late` are left out."""
    timed = events.withColumn("at", F.timestamp_millis("t")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "category").agg(F.count("*").alias("n")).select("window.start", "category", "n")
