"""Detectors over text, markup, headers and structural features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages written in Latin script.
LATIN_LANGUAGES = (
    "en", "es", "fr", "de", "pt", "it", "nl", "sv", "da", "no", "nb", "nn", "fi", "is", "pl", "cs", "sk", "sl", "hr", "ro",
    "hu", "tr", "et", "lv", "lt", "ga", "cy", "ca", "gl", "eu", "af", "sw", "id", "ms", "tl", "vi", "lb", "mt",
)

_CLASSES = {
    "ascii": r"[A-Za-z]",
    "digit": r"[0-9]",
    "han": r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]",
    "hangul": r"[\x{AC00}-\x{D7A3}]",
    "pua": r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]",
}
_NOT_SMALL = r"\x{0000}-\x{007F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{AC00}-\x{D7A3}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x{2000}-\x{206F}\x{2190}-\x{2BFF}\x{1F000}-\x{1FFFF}\x{FE00}-\x{FE0F}"


def is_latin_language(lang: Column) -> Column:
    return F.coalesce(F.get(F.split(F.lower(lang), "[-_]"), F.lit(0)).isin(*LATIN_LANGUAGES), F.lit(False))


def count_class(text: Column, name: str) -> Column:
    pattern = f"[^{_NOT_SMALL}]" if name == "small" else _CLASSES[name]
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def _kinds(text: Column, name: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_CLASSES[name]})"), F.lit(1))))


def is_glyph_cipher(text: Column, lang: Column) -> Column:
    """Text in the letters of another script or of no script, as fonts that disguise words use them.

    Many characters of few kinds that make up 60 % of all, or, on a page in a Latin
    language, nine tenths of other letters without a Latin one or a digit.
    """
    n = {k: count_class(text, k) for k in ("ascii", "digit", "han", "hangul", "pua", "small")}
    total = n["ascii"] + n["han"] + n["hangul"] + n["small"] + n["pua"]

    def few(name: str, least: int, kinds: int = 0) -> Column:
        d = _kinds(text, name)
        return (n[name] >= least) & (n[name] >= 0.6 * total) & (d <= 100) & (2 * d < n[name]) & (d >= kinds)

    foreign = is_latin_language(lang) & (n["small"] >= 80) & (n["small"] > 0.9 * total) & (n["ascii"] == 0) & (n["digit"] == 0)
    return F.coalesce((total >= 80) & (few("han", 180) | few("hangul", 180) | few("pua", 150, 15) | foreign), F.lit(False))


def svg_embeds_html(body: Column) -> Column:
    return F.coalesce(body.rlike(r"(?i)<([a-z0-9]+:)?foreignObject[\s/>]"), F.lit(False))


def svg_runs_code(body: Column) -> Column:
    """An embedding tag, or a script tag without a type or with one of JavaScript."""
    scripts = F.regexp_extract_all(body, F.lit(r"(?i)<(?:[a-z0-9]+:)?script\b([^>]*)>"), F.lit(1))

    def runs(attributes: Column) -> Column:
        kind = F.lower(F.regexp_extract(attributes, r"(?i)\btype\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
        return (kind == "") | kind.isin("module", "text/javascript", "application/javascript") | kind.rlike(r"(^|/)(java|ecma)script$")

    return F.coalesce(body.rlike(r"(?i)<([a-z0-9]+:)?(iframe|embed|object)[\s/>]") | F.exists(scripts, runs), F.lit(False))


#: Characters of a response body that are looked at.
SVG_SCAN = 524_288


def is_svg_app(frame: Column, content_type: Column, body: Column) -> Column:
    """An SVG answer to a top-level navigation that embeds HTML and runs code."""
    head = F.substring(body, 1, SVG_SCAN)
    return F.coalesce((frame == "main_frame") & F.lower(content_type).contains("image/svg+xml") & svg_embeds_html(head) & svg_runs_code(head), F.lit(False))


def has_bare_header(headers: Column) -> Column:
    """Any header whose name begins with x-bare-."""
    return F.coalesce(F.exists(headers, lambda h: F.lower(h["name"]).startswith("x-bare-")), F.lit(False))


def _flag(s: Column, name: str) -> Column:
    return F.coalesce(s[name].cast("boolean"), F.lit(False))


def _number(s: Column, name: str) -> Column:
    return F.coalesce(s[name].cast("double"), F.lit(0.0))


def is_article_about(category: Column, s: Column) -> Column:
    """A block on `category` to be overturned: prose with few links, without what the category would work with."""
    prose = (_number(s, "link_density") < 0.33) & (_number(s, "paragraph_count") >= 3) & ~_flag(s, "has_dominant_canvas")
    tool = (
        F.when(category == "proxy-bypass", _flag(s, "url_embeds_url") | _flag(s, "has_url_like_input"))
        .when(category == "adult", _flag(s, "has_video_player"))
        .when(category == "gambling", _flag(s, "has_large_xorigin_iframe") | _flag(s, "has_gambling_license_seal"))
        .otherwise(F.lit(True))
    )
    return F.coalesce(s.isNotNull() & prose & ~tool, F.lit(False))


def works_as(category: Column, s: Column) -> Column:
    """The page has the tool that its category is about, so its host may be pinned."""
    proxy = _flag(s, "url_embeds_url") | (_number(s, "fp_proxy_marker_count") > 0) | (_flag(s, "has_url_like_input") & (_number(s, "paragraph_count") < 5))
    return F.coalesce(
        F.when(category == "proxy-bypass", proxy)
        .when(category == "adult", _flag(s, "has_video_player") | _flag(s, "has_age_gate"))
        .when(category == "gambling", _flag(s, "has_large_xorigin_iframe") | _flag(s, "has_gambling_license_seal") | _flag(s, "has_payment_field"))
        .when(category == "games", _flag(s, "has_dominant_canvas"))
        .otherwise(F.lit(False)),
        F.lit(False),
    )
