"""Structural features of pages from their HTML, one row per page, in Arrow batches.

What only a layout engine knows is taken from width and height attributes, against a
viewport of 1366 x 768, or is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sluice.plans.session import spread, with_small_batches

VIEWPORT = 1366 * 768
MAX_LINKS, MAX_NODES = 200, 15_000
#: Bytes of pages whose features are made at once; a longer page is with those up to it.
SLICE = 1 << 18

# Marks of advertising, affiliate, payment and proxy software.
ADULT_NETWORKS = ("exoclick", "juicyads", "trafficjunky", "eroadvertising", "adxxx", "trafficstars", "popads", "adsterra", "plugrush", "hilltopads", "clickadu", "tsyndicate", "adnium", "ero-advertising")
GAMBLING_AFFILIATES = ("income-access", "incomeaccess", "raventrack", "netrefer", "myaffiliates", "cellxpert", "smartico", "betradar", "sportradar", "everymatrix", "softswiss", "pragmaticplay", "evolution", "1xbet", "betano")
CRYPTO_WIDGETS = ("coinbase-commerce", "coingate", "nowpayments", "cryptomus", "coinpayments", "binance", "metamask", "walletconnect", "web3modal", "moonpay", "wert.io")
PROXY_MARKS = ("powered by glype", "glype", "cgiproxy", "phproxy", "powered by php-proxy", "miniproxy", "php-proxy", "x-proxy", "/browse.php?u=", "/nph-proxy")
LICENSE_SEAL = re.compile(r"(curacao|curaçao|gaming\s+license|gambling\s+commission|licensed\s+(?:and\s+regulated|by)|mga\/|malta\s+gaming|begambleaware|gamcare)", re.I)
AGE_GATE = re.compile(r"age.?(verification|gate)|must be (18|21|over)|adults only", re.I)
# Names of fields that take an address or are for search, and of payment fields.
NO_ADDRESS_TYPES = ("search", "hidden", "password")
SEARCH_NAMES = re.compile(r"\bq\b|query|search|find")
ADDRESS_NAMES = re.compile(r"\b(url|http|https|site|address|proxy|website|link)\b")
CARD_COMPLETION = re.compile(r"\bcc-(number|csc|exp)\b|\bcardnumber\b")
CARD_NAMES = re.compile(r"card.?number|\bcvv\b|\bcvc\b|\bccnum|card.?holder|expir")
POPUP = re.compile(r"window\.open\s*\(|popunder|pop_under|\.popups?\b", re.I)

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_SILENT = frozenset(("script", "style", "noscript", "template", "head", "title"))
_SIBLINGS = frozenset(("p", "li", "tr", "td", "th", "option", "dt", "dd"))
TAGS = ("div", "iframe", "script", "video", "canvas", "embed", "object", "form", "input", "a", "img")

FLOATS = ("link_density", "internal_link_ratio", "text_to_tag_ratio", "canvas_area_fraction", "largest_iframe_area_fraction", "script_host_entropy", "third_party_script_ratio", "inline_script_ratio", "image_to_text_ratio")
INTS = (
    "paragraph_count", "dom_node_count", "outbound_domain_diversity", "link_count", "input_count", "button_count", "select_count", "iframe_count", "iframe_cross_origin_count",
    *(f"tag_{t}" for t in TAGS), "max_dom_depth", "popup_indicator_count", "form_count", "password_field_count",
    "fp_adult_adnet_count", "fp_gambling_affiliate_count", "fp_crypto_widget_count", "fp_proxy_marker_count",
)
FLAGS = ("has_url_like_input", "has_dominant_canvas", "has_video_player", "iframe_cross_origin", "has_large_xorigin_iframe", "has_age_gate", "has_payment_field", "has_gambling_license_seal")
SCHEMA = ", ".join(["title string", "meta string", "text string", "links array<string>", "script_hosts array<string>", *(f"{n} double" for n in FLOATS), *(f"{n} int" for n in INTS), *(f"{n} boolean" for n in FLAGS)])

_KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in SCHEMA.split(", ")])


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: Counter = Counter()
        self.open: list[str] = []
        self.text, self.title, self.meta, self.metas = [], [], [], []
        self.anchors, self.scripts, self.frames, self.canvases, self.inputs, self.clicks, self.paragraphs = [], [], [], [], [], [], []
        self.anchor_text: list[str] | None = None
        self.paragraph: list[str] | None = None
        self.script: list[str] | None = None
        self.link_chars = self.depth = self.nodes = 0

    def updatepos(self, i, j):
        return j  # lines are not asked for

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.tags[tag] += 1
        self.nodes += 1
        if tag == "p":
            self._end_paragraph()
            self.paragraph = []
        if tag == "a":
            self._end_anchor()
            self.anchors.append(a.get("href", ""))
            self.anchor_text = []
        elif tag == "script":
            self.scripts.append([a.get("src", ""), ""])
            self.script = []
        elif tag == "iframe":
            self.frames.append(a)
        elif tag == "canvas":
            self.canvases.append(a)
        elif tag == "input":
            self.inputs.append(a)
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name == "description" or (name.startswith("og:") and name.split(":")[1] not in ("image", "video", "audio", "url")):
                self.metas.append(a.get("content", ""))
        if "onclick" in a and len(self.clicks) < 200:
            self.clicks.append(a["onclick"])
        if tag not in _VOID:
            if tag in _SIBLINGS and self.open and self.open[-1] == tag:
                self.open.pop()  # its end tag may be left out
            self.open.append(tag)
            self._deep(len(self.open))
        else:
            self._deep(len(self.open) + 1)

    def _deep(self, levels: int):
        """Depth counts from body, which is 1; what stands outside of any html and body is in it."""
        if self.nodes <= MAX_NODES and "head" not in self.open:
            self.depth = max(self.depth, levels - ("html" in self.open) + ("body" not in self.open))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self._end_anchor()
        elif tag == "p":
            self._end_paragraph()
        elif tag == "script" and self.script is not None:
            self.scripts[-1][1] = "".join(self.script)
            self.script = None
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def _end_anchor(self):
        if self.anchor_text is not None:
            self.link_chars += len(" ".join("".join(self.anchor_text).split()))
            self.anchor_text = None

    def _end_paragraph(self):
        if self.paragraph is not None:
            self.paragraphs.append("".join(self.paragraph).strip())
            self.paragraph = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
            return
        if self.open and self.open[-1] == "title":
            self.title.append(data)
        if any(t in _SILENT for t in self.open):
            return
        self.text.append(data)
        if self.anchor_text is not None:
            self.anchor_text.append(data)
        if self.paragraph is not None:
            self.paragraph.append(data)

    def close(self):
        super().close()
        self._end_anchor()
        self._end_paragraph()


@lru_cache(1 << 12)
def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


@lru_cache(1 << 12)
def _site(host: str) -> str:
    return ".".join([x for x in host.split(".") if x][-2:])


def _area(a: dict) -> float:
    try:
        return float(re.sub(r"px$", "", a.get("width", "0") or "0")) * float(re.sub(r"px$", "", a.get("height", "0") or "0"))
    except ValueError:
        return 0.0


def _entropy(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def _distinct(text: str, marks: tuple[str, ...]) -> int:
    return sum(m in text for m in marks)


# Of each way to match, a part; without one there is no match, but for letters that only the patterns take for i, k or s.
_SEAL_PARTS = ("cura", "gaming", "gambling", "licensed", "mga/", "begambleaware", "gamcare")
_AGE_PARTS = ("verification", "gate", "must be ", "adults only")
_ODD_LETTERS = "\u0130\u0131\u017f\u212a"


def _says(text: str, low: str, pattern: re.Pattern, parts: tuple[str, ...]) -> bool:
    return (any(x in low for x in parts) or any(x in text for x in _ODD_LETTERS)) and bool(pattern.search(text))


_ADDRESS = re.compile(r"https?://|[\w-]+(\.[\w-]+)+", re.I)


def _names(a: dict, *keys: str) -> str:
    return " ".join(a.get(k, "") for k in keys).lower()


def _takes_url(a: dict) -> bool:
    """A field named for an address, or with one in it, that is no search, hidden or password field."""
    names = _names(a, "name", "id", "placeholder", "aria-label")
    if SEARCH_NAMES.search(names) or a.get("role", "").lower() == "search" or (a.get("type") or "text").lower() in NO_ADDRESS_TYPES:
        return False
    return bool(ADDRESS_NAMES.search(names) or _ADDRESS.match(a.get("value", "").strip()))


def _takes_card(a: dict) -> bool:
    return bool(CARD_COMPLETION.search(a.get("autocomplete", "").lower()) or CARD_NAMES.search(_names(a, "name", "id", "placeholder")))


def extract(url: str | None, html: str | None) -> dict:
    """All features of a page; an empty page has zeros."""
    url, p = url or "", _Page()
    p.feed(html or "")
    p.close()
    site = _site(_host(url))
    text = " ".join("".join(p.text).split())
    absolute = [u for h in p.anchors if h and (u := _join(url, h)).startswith(("http://", "https://"))]
    sites = [_site(_host(u)) for u in absolute]
    sources = [_join(url, s) for s, _ in p.scripts if s]
    script_hosts = [h for s in sources if (h := _host(s))]
    frames = [(_host(_join(url, f["src"])) if f.get("src") else "", _area(f)) for f in p.frames]
    cross = [(h, area) for h, area in frames if h and _site(h) != site]
    canvas = min(4.0, max((_area(c) for c in p.canvases), default=0.0) / VIEWPORT)
    hosts = " ".join([*script_hosts, *(h for h, _ in frames if h)])
    low = text.lower()
    out = {
        "title": "".join(p.title).strip(), "meta": " ".join(m for m in p.metas if m), "text": text,
        "links": list(dict.fromkeys(absolute))[:MAX_LINKS], "script_hosts": list(dict.fromkeys(script_hosts)),
        "link_density": min(1.0, p.link_chars / len(text)) if text else 0.0,
        "internal_link_ratio": sum(s == site for s in sites) / len(sites) if sites else 0.0,
        "text_to_tag_ratio": len(text) / max(1, p.nodes),
        "canvas_area_fraction": canvas,
        "largest_iframe_area_fraction": min(4.0, max((a for _, a in frames), default=0.0) / VIEWPORT),
        "script_host_entropy": _entropy(Counter(script_hosts)),
        "third_party_script_ratio": sum(_site(h) != site for h in script_hosts) / len(sources) if sources else 0.0,
        "inline_script_ratio": (len(p.scripts) - len(sources)) / len(p.scripts) if p.scripts else 0.0,
        "image_to_text_ratio": p.tags["img"] / max(1, len(text)),
        "paragraph_count": sum(len(x) > 40 for x in p.paragraphs), "dom_node_count": p.nodes,
        "outbound_domain_diversity": len({s for s in sites if s and s != site}), "link_count": len(absolute),
        "input_count": p.tags["input"], "button_count": p.tags["button"], "select_count": p.tags["select"],
        "iframe_count": len(frames), "iframe_cross_origin_count": len(cross),
        "max_dom_depth": p.depth, "popup_indicator_count": sum(bool(POPUP.search(b)) for s, b in p.scripts if not s) + sum(bool(re.search(r"window\.open|popunder", c, re.I)) for c in p.clicks),
        "form_count": p.tags["form"], "password_field_count": sum((a.get("type") or "").lower() == "password" for a in p.inputs),
        "fp_adult_adnet_count": _distinct(hosts, ADULT_NETWORKS), "fp_gambling_affiliate_count": _distinct(hosts, GAMBLING_AFFILIATES),
        "fp_crypto_widget_count": _distinct(hosts, CRYPTO_WIDGETS), "fp_proxy_marker_count": _distinct(low, PROXY_MARKS),
        "has_url_like_input": any(map(_takes_url, p.inputs)), "has_dominant_canvas": canvas > 0.5,
        "has_video_player": p.tags["video"] > 0, "iframe_cross_origin": bool(cross),
        "has_large_xorigin_iframe": any(a / VIEWPORT > 0.25 for _, a in cross), "has_age_gate": _says(text, low, AGE_GATE, _AGE_PARTS),
        "has_payment_field": any(map(_takes_card, p.inputs)), "has_gambling_license_seal": _says(text, low, LICENSE_SEAL, _SEAL_PARTS),
    }
    return out | {f"tag_{t}": p.tags[t] for t in TAGS}


@lru_cache(1 << 12)
def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


def features_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, features) of batches of (id, url, html), of about SLICE bytes of pages at a time."""
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy()
        places = (np.cumsum(length, dtype=np.int64) - length) // SLICE
        cuts = [*np.flatnonzero(np.diff(places, prepend=-1)).tolist(), len(places)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = b.slice(i, j - i)
            made = pa.RecordBatch.from_pylist([extract(u.as_py(), h.as_py()) for u, h in zip(part.column(1), part.column(2), strict=True)], _ARROW)
            yield pa.record_batch([part.column(0), part.column(1), *made.columns], [b.schema.names[0], "url", *_ARROW.names])


def page_features(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, features of SCHEMA) of every page.

    A worker holds a batch of pages and the features of a slice of it.  Pages of files with few row groups are dealt out first.
    """
    with_small_batches(pages.sparkSession)
    each = pages.select(id_col, pages[url_col].alias("url"), pages[html_col].alias("html"))
    return spread(each).mapInArrow(features_of_batches, f"{id_col} {dict(pages.dtypes)[id_col]}, url string, {SCHEMA}")
