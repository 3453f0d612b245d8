"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to three bytes.  A node holds how
often each byte followed its context; the escape probability of method C,
distinct / (total + distinct), leads from a context to the next shorter one, and
from the empty one to equal shares.  Statistics are frozen after learning, so the
code length of a byte depends on it and the three bytes before it alone, and every
tree is laid out as tables: the exact lengths of all byte strings of three, the
escape of every context of three, and the lengths of the strings of four that any
language has seen.  A text's code length under a language is the sum over its
bytes; the shortest one names the language.

Bytes are first folded to at most 64 symbols: A-Z to a-z, runs of what is no
letter to one blank, rare bytes to one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._store import bounded_batches
from sluice.llm._text import LOWER, doc_groups, text_buffer
from sluice.llm._worker import trimmed

#: Symbol 0 is the blank, symbol 1 all bytes without one of their own.
SYMBOLS = 64
ORDER = 3
#: Documents of a language that its statistics are learned from, about; beyond it an even sample by hash of the id.
SAMPLE_PER_LANGUAGE = 800
#: Languages that tables are made for at most: 2 * 64**3 doubles each.
MOST_LANGUAGES = 200
#: Bits between two languages count this much in the score, as neighbouring bytes are not independent.
TEMPER = 0.1

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def symbol_table(byte_counts: np.ndarray) -> np.ndarray:
    """Symbol of each byte, from how often folded letter bytes occur: the most frequent have their own."""
    table = np.where(_LETTER, 1, 0).astype(np.uint8)
    order = np.argsort(-byte_counts, kind="stable")
    own = [b for b in order if _LETTER[b] and not 65 <= b <= 90 and byte_counts[b]][: SYMBOLS - 2]
    table[own] = np.arange(2, 2 + len(own))
    table[65:91] = table[97:123]
    return table


def grams(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of four symbols as numbers below 64**4, each ending at a byte, and the document of each.

    A document stands after a blank; blanks after blanks are left out.
    """
    n = len(data)
    sym = table[data].astype(np.uint32)
    before = np.zeros(n, np.uint32)
    before[1:] = sym[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    before[begins] = 0
    keep = (sym != 0) | (before != 0)
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    s = sym[keep]
    m = len(s)
    key, shifted = s.copy(), s
    head = np.zeros(m, bool)
    head[ends[:-1][ends[:-1] < m]] = True
    for k in range(1, ORDER + 1):
        prior = np.zeros(m, np.uint32)
        prior[1:] = shifted[:-1]
        prior[head] = 0  # what is before a document is blank
        key |= prior << np.uint32(6 * k)
        shifted = prior
    return key, ends


class Model:
    """Frozen statistics of all languages, as tables of code lengths in bits."""

    def __init__(self, languages: list[str], table: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]):
        self.languages, self.table = languages, table
        n = SYMBOLS
        seen = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)])).astype(np.int64)
        self.seen = seen
        self.bits3 = np.empty((n**3, len(languages)), np.float32)
        self.escape3 = np.empty((n**3, len(languages)), np.float32)
        self.bits4 = np.empty((len(seen), len(languages)), np.float32)
        for i, (key, count) in enumerate(zip(keys, counts, strict=True)):
            bits = np.full(n, np.log2(n))  # order -1
            for order in range(ORDER):
                freq = np.bincount(key % n ** (order + 1), count, n ** (order + 1)).reshape(-1, n)
                shorter = np.tile(bits.reshape(n ** max(order - 1, 0), n), (n if order else 1, 1))
                bits = self._level(freq, shorter)
            self.bits3[:, i] = bits.ravel()
            total = np.bincount(key // n, count, n**3)
            kinds = np.bincount(key // n, minlength=n**3)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escape3[:, i] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            own = np.zeros(len(seen))
            own[np.searchsorted(seen, key)] = count
            context = seen // n
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = -np.log2(own / (total + kinds)[context])
            self.bits4[:, i] = np.where(own > 0, direct, self.escape3[context, i] + self.bits3[seen % n**3, i])

    @staticmethod
    def _level(freq: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, kinds = freq.sum(1, keepdims=True), (freq > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            direct = -np.log2(freq / (total + kinds))
        return np.where(freq > 0, direct, escape + shorter)

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """For each context of three, the symbols seen after it as bits, and the place in `seen` of the first."""
        context, symbol = self.seen // SYMBOLS, (self.seen % SYMBOLS).astype(np.uint64)
        bits = np.zeros(SYMBOLS**3, np.uint64)
        np.bitwise_or.at(bits, context, np.uint64(1) << symbol)
        return bits, np.searchsorted(context, np.arange(SYMBOLS**3)).astype(np.int32)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Bits of every document under every language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(self.languages):
            return out
        for i, j in doc_groups(offsets):
            a, b = offsets[i], offsets[j]
            if j == i + 1 and b - a > 1 << 20:  # a very long text: pieces that carry the bytes before them
                out[i] = self._long(data[a:b], index)
                continue
            key, ends = grams(data[a:b], offsets[i : j + 1] - a, self.table)
            out[i:j] = self._sums(key, ends, index)
        return out

    def _sums(self, key, ends, index):
        if not len(key):
            return np.zeros((len(ends) - 1, len(self.languages)))
        context, symbol = key >> np.uint32(6), (key & np.uint32(SYMBOLS - 1)).astype(np.uint64)
        bits = index[0][context]
        known = (bits >> symbol) & np.uint64(1) != 0
        at = index[1][context] + np.bitwise_count(bits & ((np.uint64(1) << symbol) - np.uint64(1)))
        cost = self.bits4[np.minimum(at, len(self.seen) - 1)] if len(self.seen) else np.zeros((len(key), len(self.languages)), np.float32)
        new = np.flatnonzero(~known)
        if len(new):
            k = key[new].astype(np.int64)
            cost[new] = self.escape3[k // SYMBOLS] + self.bits3[k % SYMBOLS**3]
        # Sums per document in doubles; documents without a byte have none.
        out = np.zeros((len(ends) - 1, len(self.languages)))
        some = np.flatnonzero(ends[1:] > ends[:-1])
        if len(some):
            out[some] = np.add.reduceat(cost, ends[some], axis=0, dtype=np.float64)
        return out

    def _long(self, data, index, step=1 << 19):
        total = np.zeros(len(self.languages))
        carry = np.zeros(0, np.uint8)
        for at in range(0, len(data), step):
            # the bytes before decide the context, and are counted once: their own cost is taken off
            piece = np.concatenate([carry, data[at : at + step]])
            for part, sign in ((piece, 1), (carry, -1)):
                key, ends = grams(part, np.array([0, len(part)]), self.table)
                total += sign * self._sums(key, ends, index)[0]
            # enough to hold four symbols and the blank before them, whatever runs of blanks there are
            keep = np.flatnonzero((self.table[piece] != 0) | np.concatenate([[True], self.table[piece][:-1] != 0]))[-8:]
            carry = piece[keep]
        return total


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from the rows with a language, about `sample` of each language or all if fewer.

    The sample is of whole texts, drawn by hash of id and text.  What reaches the
    driver is bounded by the sample: the strings of four symbols in it, with counts.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], symbol_table(np.zeros(256)), [], [])
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    drawn = rows.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")

    def count_bytes(batches):
        total = np.zeros(256, np.int64)
        for b in batches:
            total += np.bincount(LOWER[text_buffer(b.column("text"))[0]], minlength=256)
        yield pa.record_batch([pa.array(total.tolist(), pa.int64()), pa.array(range(256), pa.int32())], ["n", "byte"])

    bytes_seen = np.zeros(256)
    for r in drawn.mapInArrow(trimmed(count_bytes), "n long, byte int").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        bytes_seen[r["byte"]] = r["n"]
    table = symbol_table(bytes_seen)
    number = {lang: i for i, lang in enumerate(languages)}

    def count_grams(batches):
        for b in batches:
            langs = np.array([number.get(x, -1) for x in b.column("lang").to_pylist()])
            for i in np.unique(langs[langs >= 0]):
                data, offsets = text_buffer(b.column("text").filter(pa.array(langs == i)))
                found: dict[int, int] = {}
                for p, q in doc_groups(offsets):
                    key, n = np.unique(grams(data[offsets[p] : offsets[q]], offsets[p : q + 1] - offsets[p], table)[0], return_counts=True)
                    for k, c in zip(key.tolist(), n.tolist(), strict=True):
                        found[k] = found.get(k, 0) + c
                yield pa.record_batch([pa.array([int(i)] * len(found), pa.int32()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "key", "n"])

    got = drawn.mapInArrow(trimmed(count_grams), "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    keys, counts = [], []
    for i in range(len(languages)):
        own = got[got["lang"] == i].sort_values("key")
        keys.append(own["key"].to_numpy(np.int64))
        counts.append(own["n"].to_numpy(np.float64))
    return Model(languages, table, keys, counts)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (the id, by default), lang_pred and score of every row, from the text alone.

    `und` with score 0 where the text is null or has no letter, or no language was
    learned.  Ties go to the first language by name.  The score is the share of the
    language's likelihood, tempered, among all.  Rows that repeat an id are predicted one
    by one; a very long text is read in pieces; an empty table gives no row.  Columns of
    `keep` called lang_pred or score are replaced.  No shuffle; the model has two tables of
    64**3 numbers a language, and as many rows a language as its sample has strings of four.
    """
    keep = [id_col] if keep is None else keep
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = m.index()
        for b in batches:
            texts = b.column(text_at)
            data, offsets = text_buffer(texts)
            bits = m.code_lengths(data, offsets, index)
            some = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
            plain = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])[offsets]
            letters = plain[1:] > plain[:-1]
            for i in np.flatnonzero(~letters & (some[1:] > some[:-1])):
                letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
            if m.languages:
                best = bits.argmin(1)
                rest = np.exp2(np.clip(-(bits - bits.min(1, keepdims=True)) * TEMPER, -1000, 0)).sum(1)
                names = np.array(m.languages, object)[best]
                scores = np.where(letters, 1 / rest, 0.0)
                names[~letters] = "und"
            else:
                names, scores = np.full(len(bits), "und", object), np.zeros(len(bits))
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(names.tolist(), pa.string()), pa.array(scores)], [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    # names of our own inside, so that columns called like ours do no harm; the text goes once
    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["__lang string", "__score double"])
    more = [] if text_col in keep else [docs[text_col].alias("text")]
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    out = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *more).mapInArrow(trimmed(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in ("lang_pred", "score")], F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def identify(docs: DataFrame, learn: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`predict` on `docs` with the model that `learn` gives."""
    return predict(docs, train(learn, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col=id_col, text_col=text_col)
