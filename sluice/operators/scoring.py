"""Text and tree models over hashed terms, and the decision that joins their scores."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.detect import is_article_about
from sluice.functions.text import DIMS, term_vector
from sluice.functions.urls import is_search_url
from sluice.operators.lookup import checked_broadcast
from sluice.operators.rank import numbered

TREE_THRESHOLD, TEXT_THRESHOLD, TEXT_ONLY_THRESHOLD = 0.97, 0.89, 0.80


def features(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS) -> DataFrame:
    """(id, features): sparse unit vectors of signed hashed terms; a text without terms has an empty one."""

    @F.udf(VectorUDT())
    def sparse(pairs):
        return SparseVector(dims, sorted((int(p["idx"]), float(p["value"])) for p in pairs or []))

    packed = term_vector(df, id_col, text_col, dims).groupBy(id_col).agg(F.collect_list(F.struct("idx", "value")).alias("pairs"))
    return df.select(id_col).join(packed, id_col, "left").select(id_col, sparse("pairs").alias("features"))


@dataclass
class TextModel:
    """Linear scores of classes over hashed terms."""

    classes: list[str]
    coef: np.ndarray
    intercept: np.ndarray

    def save(self) -> tuple[bytes, dict]:
        """Little-endian float32 weights, class by class, and what else describes them."""
        meta = {"classes": self.classes, "dims": int(self.coef.shape[1]), "intercept": [float(x) for x in self.intercept]}
        data = self.coef.astype("<f4").tobytes()
        return data, meta | {"version": content_id(data, meta)}

    @classmethod
    def load(cls, data: bytes, meta: dict) -> TextModel:
        return cls(meta["classes"], np.frombuffer(data, "<f4").reshape(len(meta["classes"]), meta["dims"]), np.asarray(meta["intercept"]))


def content_id(weights: bytes, meta: dict, trees: bytes = b"") -> str:
    """Sixteen digits that name a model by its contents, the version in `meta` left out.

    Fixed values, as devices compute them too: JSON with sorted keys and no blanks; eight
    bytes of length, the highest first, before each part; SHA-256.
    """
    described = json.dumps({k: v for k, v in meta.items() if k != "version"}, sort_keys=True, separators=(",", ":")).encode()
    framed = b"".join(struct.pack(">Q", len(part)) + part for part in (weights, described, trees))
    return hashlib.sha256(framed).hexdigest()[:16]


def model_megabytes(n_classes: int, dims: int) -> float:
    return n_classes * (dims + 1) * 4 / 1e6


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """`df` with weight: rows of each label together weigh the same."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    return df.join(F.broadcast(counts.join(total).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))), label)


def train_text(df: DataFrame, label: str = "label", features_col: str = "features", c: float = 4.0, max_iter: int = 100) -> TextModel:
    """Multinomial regression on class-balanced rows, L2 of 1 / (c n)."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    index = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(label)) - 1
    rows = with_class_weights(df, label).withColumn("y", index.cast("double"))
    lr = LogisticRegression(featuresCol=features_col, labelCol="y", weightCol="weight", family="multinomial", regParam=1.0 / (c * max(rows.count(), 1)), standardization=False, maxIter=max_iter)
    m: LogisticRegressionModel = lr.fit(rows)
    return TextModel(classes, m.coefficientMatrix.toArray(), m.interceptVector.toArray())


def score_text(df: DataFrame, model: TextModel, id_col: str, text_col: str) -> DataFrame:
    """(id, class, score) for every class: softmax of intercept and summed weights; terms meet the weights of a broadcast model."""
    shared = df.sparkSession.sparkContext.broadcast((model.coef.astype(np.float32), model.intercept))
    dims, classes = model.coef.shape[1], model.classes
    vectors = term_vector(df, id_col, text_col, dims).groupBy(id_col).agg(F.collect_list(F.struct("idx", "value")).alias("p"))
    vectors = df.select(id_col).join(vectors, id_col, "left").select(id_col, F.transform("p", lambda x: x["idx"]).alias("idx"), F.transform("p", lambda x: x["value"]).alias("value"))

    @F.pandas_udf("array<double>")
    def probabilities(idx: pd.Series, value: pd.Series) -> pd.Series:
        coef, intercept = shared.value
        out = []
        for i, v in zip(idx, value, strict=True):
            z = intercept + (coef[:, np.asarray(i, np.int64)] @ np.asarray(v, np.float64) if i is not None and len(i) else 0)
            e = np.exp(z - z.max())
            out.append(e / e.sum())
        return pd.Series(out)

    scored = vectors.select(id_col, F.posexplode(probabilities("idx", "value")).alias("k", "score"))
    return scored.select(id_col, F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("k") + 1).alias("class"), "score")


@dataclass
class Trees:
    """Boosted trees: nodes are (feature, threshold, left, right, value, is_leaf, missing_left), by round and class."""

    classes: list[str]
    baseline: list[float]
    rounds: list[list[list[tuple]]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums per class; all rows of `x` go down each tree together."""
        out = np.tile(np.asarray(self.baseline, np.float64), (len(x), 1))
        for trees in self.rounds:
            for k, nodes in enumerate(trees):
                table = np.asarray([tuple(float(v) for v in n) for n in nodes])
                at = np.zeros(len(x), np.int64)
                while True:
                    n = table[at]
                    inner = n[:, 5] == 0
                    if not inner.any():
                        break
                    value = x[np.arange(len(x)), n[:, 0].astype(np.int64)]
                    left = np.where(np.isnan(value), n[:, 6] != 0, value <= n[:, 1])
                    at = np.where(inner, np.where(left, n[:, 2], n[:, 3]).astype(np.int64), at)
                out[:, k] += table[at, 4]
        return out

    def save(self) -> bytes:
        """JSON; numbers as they are, so that a loaded model gives the same scores."""
        return json.dumps({"classes": self.classes, "baseline": self.baseline, "trees": self.rounds}, separators=(",", ":")).encode()

    @classmethod
    def load(cls, data: bytes) -> Trees:
        found = json.loads(data)
        return cls(found["classes"], found["baseline"], [[[tuple(n) for n in nodes] for nodes in trees] for trees in found["trees"]])

    def exported(self, x: np.ndarray, expected: np.ndarray | None = None, most: float = 1e-6) -> bytes:
        """`save`, held against expected probabilities (its own, if none are given) on the rows of `x`: what is loaded must give them."""
        data = self.save()
        apart = float(np.abs(Trees.load(data).probabilities(x) - (self.probabilities(x) if expected is None else expected)).max(initial=0.0))
        if not apart < most:
            raise ValueError(f"exported trees are {apart} from the model")
        return data

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def score_trees(df: DataFrame, trees: Trees, inputs: list[Column], out: str = "scores") -> DataFrame:
    """`df` with an array of class probabilities; inputs that are null or not finite count as 0."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def clean(c: Column) -> Column:
        v = c.cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for x in batches:
            yield pd.Series(list(model.probabilities(np.stack(x.to_list()).astype(np.float64)))) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(out, score(F.array(*[clean(c) for c in inputs])))


def train_trees(df: DataFrame, classes: list[str], inputs: list[str], label: str = "label", trees: int = 40, depth: int = 6, seed: int = 0) -> tuple[Trees, object]:
    """A forest for several classes, in the form of `Trees`; Spark's boosting knows two classes only.

    A leaf's class shares are added up over the trees.
    """
    from pyspark.ml.feature import VectorAssembler

    index = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(label)) - 1
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(with_class_weights(df, label).withColumn("y", index.cast("double")))
    m = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    share = lambda k: lambda n: (stats := list(n.impurityStats().stats()))[k] / max(sum(stats), 1e-12)
    rounds = [[_nodes(t, share(k)) for k in range(len(classes))] for t in m.trees]
    return Trees(classes, [0.0] * len(classes), rounds), m


def _nodes(tree, leaf) -> list[tuple]:
    """The nodes of one of Spark's trees in the form of `Trees`; `leaf(node)` is what a leaf adds."""
    nodes: list[tuple] = []

    def visit(node) -> int:
        i = len(nodes)
        nodes.append(())
        if node.numDescendants() == 0:
            nodes[i] = (0, 0.0, 0, 0, leaf(node), True, False)
        else:
            split = node.split()
            left, right = visit(node.leftChild()), visit(node.rightChild())
            nodes[i] = (split.featureIndex(), split.threshold(), left, right, 0.0, False, True)
        return i

    visit(tree._java_obj.rootNode())
    return nodes


def train_boosted(df: DataFrame, classes: list[str], inputs: list[str], label: str = "label", rounds: int = 20, depth: int = 6, rate: float = 0.08, seed: int = 0) -> tuple[Trees, list]:
    """Boosted trees for several classes, one class against the rest at a time, in the form of `Trees`; and Spark's models.

    A class's score is the log odds that its own trees give; probabilities are their softmax.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(with_class_weights(df, label))
    models, found = [], []
    for c in classes:
        own = rows.withColumn("y", (F.col(label) == c).cast("double"))
        m = GBTClassifier(labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(own)
        models.append(m)
        # Spark's margin is half the log odds
        found.append([_nodes(t, lambda n, w=w: 2 * w * n.prediction()) for t, w in zip(m.trees, m.treeWeights, strict=True)])
    return Trees(classes, [0.0] * len(classes), [list(trees) for trees in zip(*found, strict=True)]), models


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """`df` with fold 1..k, even within each label, in hash order; a label may hold most rows, as places are counted over all labels."""
    from sluice.operators.corpus import hash_order

    placed = numbered(df, F.col(label), *hash_order(seed, key), name="__n")
    of = placed.groupBy(F.col(label).alias("__label")).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    at, size = F.col("__n") - F.col("__first"), F.floor(F.col("__size") / k)
    wide = (F.col("__size") % k) * (size + 1)  # the first folds have one more
    fold = F.when(at < wide, F.floor(at / (size + 1))).otherwise(F.col("__size") % k + F.floor((at - wide) / F.greatest(size, F.lit(1)))) + 1
    return placed.join(checked_broadcast(of), F.col(label).eqNullSafe(F.col("__label"))).select(*df.columns, fold.cast("int").alias("fold"))


def best_blocked(scores: Column, classes: list[str], clean: str = "clean") -> Column:
    """struct(category, confidence) of the highest score that is not clean, the first on ties; clean and -1 if there is none."""
    best = F.struct(F.lit(clean).alias("category"), F.lit(-1.0).alias("confidence"))
    for i, c in enumerate(classes):
        if c != clean:
            p = F.get(scores, F.lit(i)).cast("double")
            best = F.when(p > best["confidence"], F.struct(F.lit(c).alias("category"), p.alias("confidence"))).otherwise(best)
    return best


def decide(url: Column, text_scores: Column, tree_scores: Column, structural: Column, classes: list[str], clean: str = "clean", tree_threshold: float = TREE_THRESHOLD, text_threshold: float = TEXT_THRESHOLD) -> Column:
    """struct(category, confidence, reason): search pages are let through; then trees decide, then the text unless the page is an article."""
    f, t = best_blocked(tree_scores, classes, clean), best_blocked(text_scores, classes, clean)
    out = lambda c, p, r: F.struct(c.alias("category"), p.alias("confidence"), F.lit(r).alias("reason"))
    return (
        F.when(is_search_url(url), out(F.lit(clean), F.lit(0.0), "serp-exempt"))
        .when(f["confidence"] >= tree_threshold, out(f["category"], f["confidence"], "fusion"))
        .when((t["confidence"] >= text_threshold) & ~is_article_about(t["category"], structural), out(t["category"], t["confidence"], "text-backstop"))
        .otherwise(out(F.lit(clean), F.greatest(f["confidence"], t["confidence"]), "-"))
    )


def decide_with_policy(text_scores: Column, tree_scores: Column | None, structural: Column, classes: list[str], override: float | None = None, clean: str = "clean") -> Column:
    """struct(category, confidence) or null: a policy's threshold replaces that of the trees and raises that of the text; without trees the text decides alone."""
    t = best_blocked(text_scores, classes, clean)
    if tree_scores is None:
        return F.when(t["confidence"] >= (TEXT_ONLY_THRESHOLD if override is None else override), t)
    f = best_blocked(tree_scores, classes, clean)
    tree_threshold = TREE_THRESHOLD if override is None else override
    text_threshold = TEXT_THRESHOLD if override is None else max(TEXT_THRESHOLD, override)
    return F.when(f["confidence"] >= tree_threshold, f).when((t["confidence"] >= text_threshold) & ~is_article_about(t["category"], structural), t)


def evaluate_text(top_category: Column, confidence: Column, url: Column, threshold: float, clean: str = "clean") -> Column:
    """The category if it is sure enough and the page no search page, else clean."""
    return F.when(~is_search_url(url) & (confidence >= threshold), top_category).otherwise(clean)


