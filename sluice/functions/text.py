"""Text, hash and formatting functions: native column expressions, but for fingerprints and term vectors of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import wordhash

#: Dimensions of the hashed term vector.
DIMS = 65_536
#: Tokens, and characters before them, that a record keeps of a page.
RECORD_TOKENS, RECORD_CHARS = 400, 6_400
_MASK = 0xFFFFFFFF


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as numbers; where every character is one byte, its code."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    pairs = F.filter(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda x: x != "")
    plain = F.transform(F.split(text, ""), lambda x: F.ascii(x).cast("long"))
    return F.when(F.octet_length(text) == 0, F.array().cast("array<bigint>")).when(F.octet_length(text) == F.length(text), plain).otherwise(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long")))


def fnv1a32(text: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as a bigint."""
    return F.aggregate(_bytes(_c(text)), F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(_MASK).cast("long")))


def fnv1a64(text: Column | str) -> Column:
    """FNV-1a of the bytes, 64 bits, as the bigint of the same bits; worked in halves, as a whole product overflows."""
    mask = F.lit(_MASK).cast("long")
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))

    def step(a: Column, b: Column) -> Column:
        x = a["lo"].bitwiseXOR(b)
        # times 2^40 + 435
        low = x * F.lit(435).cast("long")
        high = a["hi"] * F.lit(435).cast("long") + F.shiftrightunsigned(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    return F.aggregate(_bytes(_c(text)), start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))


def hex64(h: Column | str) -> Column:
    """Sixteen hexadecimal digits of a bigint's bits."""
    return F.lower(F.lpad(F.hex(_c(h)), 16, "0"))


def unsigned_order(h: Column | str) -> Column:
    """A bigint that sorts as the unsigned value of the bits would."""
    return _c(h).bitwiseXOR(F.lit(-(2**63)))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def terms(text: Column | str) -> Column:
    """Words, pairs of neighbours, and three and four letters of each bordered word; order is that of the words."""
    w = words(text)

    def grams(word: Column) -> Column:
        bordered = F.concat(F.lit("^"), word, F.lit("$"))
        n = F.length(bordered)
        cut = lambda k: F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i <= n - k + 1), lambda i: F.concat(F.lit("#"), F.substring(bordered, i, F.lit(k))))
        return F.concat(cut(3), cut(4))

    each = F.transform(w, lambda x, i: F.concat(F.array(x), F.when(i + 1 < F.size(w), F.array(F.concat(x, F.lit(" "), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>")), grams(x)))
    return F.flatten(each)


def term_vector(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """(id, idx, value): the signed hashed term vector of length 1, a row per index; texts whose signs all cancel have none.

    `dims` is a power of two.  Each row's vector is made where the row is; nothing is shuffled.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, idx long, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, idx, value in wordhash.term_vectors(b.column(1), dims):
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(idx), pa.array(value)], [id_col, "idx", "value"])

    return df.select(id_col, F.lower(text_col).alias("text")).mapInArrow(run, schema)


def simhash(df: DataFrame, id_col: str, text_col: str, out: str = "simhash", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, simhash) and the columns `keep`: 64 signed-bit votes of word tokens, each hashed forwards and backwards; 0 without tokens.

    Every word votes as often as it occurs.  Each row's votes are summed where the row is; nothing is shuffled.
    """
    columns = [id_col, *keep]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = wordhash.simhashes(b.column(len(columns))).view(np.int64)
            yield pa.record_batch([*b.columns[: len(columns)], pa.array(made)], [*columns, out])

    return df.select(*columns, F.lower(text_col).alias("__text")).mapInArrow(run, schema)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def whole_document(title: Column, meta: Column, text: Column) -> Column:
    """Title, description and text with a blank between, also where one is missing."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(meta, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def without_data_uris(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?i)data:[^\s'\"<>]+", " ")


def record_text(text: Column | str) -> Column:
    """The first tokens of a page, with single blanks between."""
    clean = F.regexp_replace(F.substring(without_data_uris(text), 1, RECORD_CHARS), r"(?U)\s+", " ")
    return F.array_join(F.slice(F.filter(F.split(clean, " "), lambda x: x != ""), 1, RECORD_TOKENS), " ")


def relative_time(ts_ms: Column, now_ms: Column) -> Column:
    """never, just now, or minutes, hours or days ago; the future is just now."""
    sec = F.greatest(F.lit(0), F.floor((now_ms - ts_ms) / 1000))
    minutes, hours, days = F.floor(sec / 60), F.floor(sec / 3600), F.floor(sec / 86400)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(F.coalesce(ts_ms, F.lit(0)) == 0, "never").when(sec < 60, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).otherwise(ago(days, "d"))


# Names of block sources in reports.
SOURCE_NAMES = {"list": "URL filter", "model": "Content model", "proxy": "Web-proxy detector", "district-policy": "District policy"}


def source_name(source: Column | str) -> Column:
    s = _c(source)
    named = F.lit(None).cast("string")
    for code, name in SOURCE_NAMES.items():
        named = F.when(s == code, name).otherwise(named)
    return F.coalesce(named, F.nullif(s, F.lit("")), F.lit("URL filter"))


def reference_code(category: Column, source: Column, at: Column) -> Column:
    """First letters of category (x if none) and source, and the UTC minute."""
    first = F.when(F.coalesce(category, F.lit("")) == "", "x").otherwise(F.substring(category, 1, 1))
    return F.upper(F.concat(first, F.substring(source, 1, 1), F.lit("-"), F.date_format(at, "yyyyMMddHHmm")))


def map_total(counts: Column) -> Column:
    """Sum of a map's values, 0 if there is none."""
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def softmax(values: Column) -> Column:
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def coerced_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def coerced_double(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(F.isnan(number) | number.isNull() | (F.abs(number) == float("inf")), F.lit(0.0)).otherwise(number)
