"""Toxicity by nearest labelled examples, under exact TF-IDF cosine over a block-max inverted index.

Texts are read as bytes: A-Z to a-z, runs of other bytes than letters and digits to
one blank.  Terms are all strings of four, six and eight such bytes, taken as numbers,
so stems show in any word that holds them.  From a bounded, balanced sample of labelled
rows, the terms are kept that are more frequent in toxic examples than chance allows.
Every vector also has one constant term: texts with little of those terms are near
each other, and near the clean examples, rather than near whatever shares one term.
A toxic example without any of the terms, and all near copies of it, have one term of
their own instead.

The index keeps postings in blocks of examples and, for every term and block, the
greatest weight.  A query's blocks are taken by their bound, the sum of its weights
times those, until the bound is below the k-th best cosine found, so the neighbours
are those of a full scan.  Neighbours vote by closeness; the votes of the sample's
own rows, each without itself, give the calibration to a score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._store import bounded_batches, discard, stored
from sluice.llm._text import doc_groups, hash_words, shingle_hashes, text_buffer
from sluice.llm._worker import trimmed

#: Labelled examples of each kind that the classifier is fitted on, about; beyond them an even sample by hash.
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 1024, 2048
#: Terms kept at most; standard deviations by which, and times that, they must be more frequent in toxic examples; the least share of those that has them.
TERMS, LEAST_Z, LEAST_RATIO, LEAST_SHARE = 2048, 4.5, 2.0, 0.015
#: Neighbours that vote, and examples of a block.
NEIGHBOURS, BLOCK = 15, 64
#: Weight of the constant term, and of the term that near copies of a toxic example have.
CONSTANT, COPY = 3.0, 9.0
LENGTHS = (4, 6, 8)
#: Times at which a term has half the weight it can have, in texts up to so many bytes; in longer ones, as many more times: they have more of everything by chance.
HALF, SHORT = 1.5, 300

_U = np.uint64
_SEEDS = [int(x) for x in np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, 6)]
_PAIR = [int(x) | 1 for x in np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, 2)]
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, document) of every string of four, six and eight folded bytes; documents stand between blanks."""
    n = len(data)
    folded = _FOLD[data]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # a blank before each document keeps terms within it
    padded = np.full(n + len(offsets), 32, np.uint8)
    padded[np.arange(n) + doc + 1] = folded
    where = np.zeros(len(padded), np.int64)
    where[np.arange(n) + doc + 1] = doc
    where[offsets[1:] + np.arange(1, len(offsets))] = np.arange(len(offsets) - 1)  # the blank after a document is its own
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    borders = offsets + np.arange(len(offsets))
    keep[borders] = True
    s, where = padded[keep].astype(np.uint64), where[keep]
    out, docs = [], []
    for k in LENGTHS:
        if len(s) < k:
            continue
        key = np.full(len(s) - k + 1, k, np.uint64)
        for i in range(k):
            key = (key << _U(8)) | s[i : len(s) - k + 1 + i]
        inner = np.ones(len(key), bool)
        for i in range(1, k - 1):  # a blank inside ends a term's word: such terms are left out
            inner &= s[i : len(s) - k + 1 + i] != 32
        out.append(key[inner])
        docs.append(where[k - 1 :][inner])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(docs)


def _counted(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, document) with their number."""
    if not len(key):
        return key, doc, np.zeros(0, np.int64)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], doc[at], np.diff(np.append(at, len(key)))


def copy_marks(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Numbers of each text of which near copies share one: pairs of its least shingle hashes under several seeds; none without words."""
    w = hash_words(data, offsets)
    out = []
    for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True):
        keys = shingle_hashes(w.h[a:b], 3)
        least = [int(((keys ^ _U(seed)) * _U(0x9E3779B97F4A7C15)).min()) for seed in _SEEDS] if len(keys) else []
        out.append(np.array([(x * _PAIR[0] + y * _PAIR[1] + i * 64 + j) % (1 << 64) for i, x in enumerate(least) for j, y in enumerate(least[:i])], np.uint64))
    return out


def _is_new(marks: np.ndarray, seen: set) -> bool:
    """False for a near copy of a text seen before: copies would make their chance terms look frequent."""
    if not len(marks):
        return True
    own = set(marks.tolist())
    known = not own.isdisjoint(seen)
    seen |= own
    return not known


class Index:
    """Postings of unit TF-IDF vectors, in blocks, with each term's greatest weight in a block."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_examples: int, n_terms: int):
        self.n, self.blocks = n_examples, -(-n_examples // BLOCK)
        order = np.lexsort((example, term))
        self.example, weight, term = example[order], weight[order].astype(np.float64), term[order]
        self.weight = weight
        place = term * self.blocks + self.example // BLOCK
        self.ptr = np.searchsorted(place, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, place, weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the `k` nearest and all as near as the last of them, nearest first."""
        bound = weight @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        ids, scores, worst, at, step = np.zeros(0, np.int64), np.zeros(0), -1.0, 0, 8
        while at < self.blocks and bound[order[at]] >= worst - 1e-12:
            chosen = order[at : at + step]
            chosen = chosen[bound[chosen] >= worst - 1e-12]
            place = (term[:, None] * self.blocks + chosen[None, :]).ravel()
            a, size = self.ptr[place], self.ptr[place + 1] - self.ptr[place]
            w = np.repeat(np.repeat(weight, len(chosen)), size)
            post = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            total = np.bincount(self.example[post], w * self.weight[post], self.n)
            new = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            new = new[(new < self.n) & (new != without)]
            ids, scores = np.concatenate([ids, new]), np.concatenate([scores, total[new]])
            if len(ids) > k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                good = scores >= worst - 1e-12
                ids, scores = ids[good], scores[good]
            at += step
        best = np.lexsort((ids, -scores))
        return ids[best], scores[best]


@dataclass
class Model:
    keys: np.ndarray  # sorted terms; the constant is number len(keys), terms of copies follow
    idf: np.ndarray
    index: Index | None
    labels: np.ndarray
    names: np.ndarray  # ids of the examples, as evidence
    slope: float
    shift: float
    marks: dict[int, int] = field(default_factory=dict)  # of toxic examples without terms: the number of their copies' term

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(44)).astype(np.int64)

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term number, unit weight), by document, each with the constant term."""
        key, doc = terms(data, offsets)
        m = self.maybe[self._slot(key)]
        key, doc = key[m], doc[m]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        ok = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        number, doc, times = _counted(at[ok].astype(np.uint64), doc[ok])
        number = number.astype(np.int64)
        n = len(offsets) - 1
        weight = times * (HALF + 1) / (times + HALF * np.maximum(np.diff(offsets) / SHORT, 1)[doc]) * self.idf[number]
        doc, number, weight = np.concatenate([doc, np.arange(n)]), np.concatenate([number, np.full(n, len(self.keys))]), np.concatenate([weight, np.full(n, CONSTANT)])
        if self.marks:
            own = [(i, g) for i, marks in enumerate(copy_marks(data, offsets)) for g in {self.marks[x] for x in marks.tolist() if x in self.marks}]
            own = np.array(sorted(own), np.int64).reshape(-1, 2)
            doc, number, weight = np.concatenate([doc, own[:, 0]]), np.concatenate([number, len(self.keys) + 1 + own[:, 1]]), np.concatenate([weight, np.full(len(own), COPY)])
        order = np.argsort(doc, kind="stable")
        doc, number, weight = doc[order], number[order], weight[order]
        return doc, number, weight / np.sqrt(np.bincount(doc, weight**2, n))[doc]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        w = 1 / (1.0001 - np.minimum(cosines, 1.0)) if len(ids) else np.zeros(0)
        if len(ids) > NEIGHBOURS:  # all as near as the last share the votes that are left: thousands of them do not outvote a copy
            ties = cosines <= cosines[NEIGHBOURS - 1] + 1e-12
            w[ties] *= (NEIGHBOURS - (~ties).sum()) / ties.sum()
        return float((w * self.labels[ids]).sum() / w.sum()) if len(ids) else 0.0

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.shift))))


def _empty() -> Model:
    return Model(np.zeros(0, np.uint64), np.zeros(0), None, np.zeros(0), np.zeros(0), 0.0, -20.0)


def calibrate(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, by Newton steps that are halved until they lower the loss."""
    x = np.stack([votes, np.ones(len(votes))], 1)

    def loss(c):
        z = x @ c
        return (weight * (np.logaddexp(0, z) - labels * z)).sum() + ridge / 2 * c @ c

    c = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ c)))
        g = x.T @ (weight * (p - labels)) + ridge * c
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        while loss(c - step) > loss(c) and abs(step).max() > 1e-9:
            step /= 2
        c = c - step
        if abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def fit(texts: list[str], labels: np.ndarray, names: list, share: float) -> Model:
    """A model of some examples; `share` is that of toxic rows among all labelled ones, for document frequencies and calibration."""
    labels = np.asarray(labels, np.float64)
    if not labels.sum():
        return _empty()
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    found, many, copies, sizes, marks = [[], []], 256, (set(), set()), [0, 0], []
    for i in range(0, len(texts), many):
        j = min(len(texts), i + many)
        key, doc, _ = _counted(*terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        own = copy_marks(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        new = np.array([_is_new(m, copies[int(y)]) for m, y in zip(own, labels[i:j], strict=True)], bool)
        marks += own
        for y in (0, 1):
            found[y].append(np.unique(key[(labels[i + doc] == y) & new[doc]], return_counts=True))
            sizes[y] += int((new & (labels[i:j] == y)).sum())

    def total(parts):
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys))

    (key0, df0), (keys, df1) = total(found[0]), total(found[1])
    at = np.minimum(np.searchsorted(key0, keys), max(len(key0) - 1, 0))
    other = np.where(key0[at] == keys, df0[at], 0) if len(key0) else np.zeros(len(keys))
    n0, n1 = sizes  # like the counts of terms, without near copies
    p1, p0 = df1 / n1, other / max(n0, 1)
    p = (df1 + other + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / max(n0, 1)))
    # Surely more frequent, and somewhat: a much greater ratio over all languages would drop the stems that only a small one has.
    good = np.flatnonzero((z >= min(LEAST_Z, 0.5 * np.sqrt(n1))) & (p1 > LEAST_RATIO * p0) & (p1 >= LEAST_SHARE))
    good = np.sort(good[np.argsort(-z[good], kind="stable")[:TERMS]])
    keys = keys[good]
    idf = 1 + np.log(1 / np.maximum(share * p1[good] + (1 - share) * p0[good], 1e-6))
    model = Model(keys, idf, None, labels, np.asarray(names), 0.0, 0.0)

    def vectors():
        parts = [], [], []
        for i, j in doc_groups(offsets):
            d, t, w = model.vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for out, x in zip(parts, (d + i, t, w), strict=True):
                out.append(x)
        return map(np.concatenate, parts)

    doc, term, weight = vectors()
    groups = 0
    for i in np.flatnonzero((np.bincount(doc, minlength=len(texts)) == 1) & (labels == 1)):
        group = min((model.marks[x] for x in marks[i].tolist() if x in model.marks), default=groups)
        groups = max(groups, group + 1) if len(marks[i]) else groups
        for x in marks[i].tolist():
            model.marks.setdefault(x, group)
    if groups:
        doc, term, weight = vectors()
    model.index = Index(doc, term, weight, len(texts), len(keys) + 1 + groups)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    votes = np.array([model.vote(*model.index.nearest(term[a:b], weight[a:b], NEIGHBOURS, i)) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))])
    # Examples count as their kind does among all labelled rows.
    a, b = calibrate(votes, labels, np.where(labels == 1, share / labels.sum(), (1 - share) / max((1 - labels).sum(), 1)) * len(labels))
    model.slope, model.shift = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC_EXAMPLES, clean: int = CLEAN_EXAMPLES) -> Model:
    """Fit on about `toxic` and `clean` labelled documents, or all if fewer.

    Beyond them the sample is over distinct texts, near copies mostly counting as one, so a
    group of copies takes no more of it than any other text.  Only the sampled documents
    reach the driver.  Rows without text, id or label are no examples; of several labels
    of a document the greatest counts, of several texts the least.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not sizes.get(1):
        return _empty()
    most = {1: toxic, 0: clean}
    over = [y for y in sizes if sizes[y] > most[y]]
    drawn = marked.where(~F.col("y").isin(over)) if over else marked
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    if over:
        kind = dict(texts.dtypes)["id"]
        keyed = texts.where("id is not null").mapInArrow(trimmed(_copy_keys), f"id {kind}, key long").join(marked.where(F.col("y").isin(over)), "id")
        distinct = stored(keyed.groupBy("key", "y").agg(F.min("id").alias("id")))
        kinds = {r["y"]: r["count"] for r in distinct.groupBy("y").count().collect()}
        rate = F.lit(0.0)
        for y, n in kinds.items():
            rate = F.when(F.col("y") == y, min(1.0, most[y] / n)).otherwise(rate)
        drawn = drawn.union(distinct.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < rate * (1 << 30)).select("id", "y").distinct())
    # The sample is bounded, so it is what is sent to the documents.
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").toArrow()
    if over:
        discard(distinct)
    share = sizes[1] / (sizes[1] + sizes.get(0, 0))
    return fit(rows["text"].to_pylist(), rows["y"].to_numpy().astype(np.float64), rows["id"].to_pylist(), share)


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key): the least hash of a text's five-word shingles, which most near copies share."""
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        keys = []
        for i, j in doc_groups(offsets):
            w = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keys += [int(shingle_hashes(w.h[p:q], 5).min()) >> 1 if q > p else 0 for p, q in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
        yield pa.record_batch([b.column("id"), pa.array(keys, pa.int64())], ["id", "key"])


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and evidence (the nearest examples' ids and cosines, three at most) of every row.

    A null or empty text, or one without any of the terms, is the constant term alone and
    has the score of its neighbours' votes like any other.  Rows that repeat an id are
    scored one by one; ids may be of any type.  Of a very long text, all terms count.  All
    examples as near as the last neighbour share its votes.  An empty table gives no row;
    other columns are left out, whatever their names.  No shuffle; the model is bounded by
    its sample.
    """
    bounded_batches(docs.sparkSession)
    whole = model.names.dtype.kind in "iuf"  # ids of the examples; of any other type they are told as text
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[bytes, tuple] = {}
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            scores, evidence = [], []
            for i, j in doc_groups(offsets):
                n = j - i
                if m.index is None:
                    scores += [m.score(0.0)] * n
                    evidence += [[]] * n
                    continue
                doc, term, weight = m.vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(doc, np.arange(n + 1))
                for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    t, w = term[p:q], weight[p:q]
                    same = hashlib.blake2b(t.tobytes() + w.tobytes(), digest_size=16).digest()
                    if same not in known:
                        ids, cosines = m.index.nearest(t, w, NEIGHBOURS)
                        if len(known) > 20_000:
                            known.clear()
                        known[same] = m.score(m.vote(ids, cosines)), [{"id": int(m.names[e]) if whole else str(m.names[e]), "cosine": float(c)} for e, c in zip(ids[:3], cosines[:3], strict=True)]
                    s, e = known[same]
                    scores.append(s)
                    evidence.append(e)
            kind = pa.list_(pa.struct([("id", pa.int64() if whole else pa.string()), ("cosine", pa.float64())]))
            yield pa.record_batch([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(evidence, kind)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int, evidence array<struct<id: {'long' if whole else 'string'}, cosine: double>>")
