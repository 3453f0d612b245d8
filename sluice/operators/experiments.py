"""Comparisons of models on one split, and learning curves."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import metrics, scoring

#: Dimensions of the hashed vectors that candidates are tried with.
DIMENSIONS = (65_536, 16_384, 4_096, 8_192)


def candidates(dims: int, classes: int, rows: int) -> dict[str, object]:
    """Estimators over (features, y), each for several classes."""
    lr = lambda c: LogisticRegression(labelCol="y", family="multinomial", regParam=1.0 / (c * max(rows, 1)), standardization=False, maxIter=50)
    svc = LinearSVC(labelCol="y", regParam=1e-4, maxIter=30)
    out = {"lr_c1": lr(1.0), "lr_c4": lr(4.0), "svc": OneVsRest(classifier=svc, labelCol="y")}
    if dims <= 8_192:
        out["mlp"] = MultilayerPerceptronClassifier(labelCol="y", layers=[dims, 16, classes], maxIter=30, seed=0)
    return out


def indexed(df: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    return df.withColumn("y", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double"))


def bakeoff(train: DataFrame, test: DataFrame, classes: list[str], *, id_col: str, text_col: str, label: str = "label", dimensions: tuple[int, ...] = DIMENSIONS, only: tuple[str, ...] | None = None) -> list[dict]:
    """Accuracy, macro-F1 and size of every candidate; vectors are made once per dimension."""
    out = []
    for dims in dimensions:
        a, b = (indexed(scoring.features(df, id_col, text_col, dims).join(df.select(id_col, label), id_col), classes, label).persist() for df in (train, test))
        for name, estimator in candidates(dims, len(classes), a.count()).items():
            if only is not None and name not in only:
                continue
            predicted = estimator.fit(a).transform(b)
            pairs = predicted.select(F.col(label).alias("y_true"), F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1).alias("y_pred"))
            row = metrics.macro_f1(pairs, classes).first()
            out.append({"model": name, "dims": dims, "accuracy": row["accuracy"], "macro_f1": row["macro_f1"], "megabytes": scoring.model_megabytes(len(classes), dims)})
        a.unpersist()
        b.unpersist()
    return out


def stacked(df: DataFrame, *, id_col: str, text_col: str, label: str = "label", folds: int = 5, seed: int = 0) -> DataFrame:
    """(id, class, score): text scores of every row by a model that has not seen its fold."""
    parts = scoring.folds(df, label, id_col, folds, seed)
    out = None
    for k in range(1, folds + 1):
        rest, own = parts.where(F.col("fold") != k), parts.where(F.col("fold") == k)
        vectors = scoring.features(rest, id_col, text_col).join(rest.select(id_col, label), id_col)
        scored = scoring.score_text(own, scoring.train_text(vectors, label), id_col, text_col)
        out = scored if out is None else out.unionByName(scored)
    return out


def at_budgets(scored: dict[str, DataFrame], budgets: tuple[float, ...] = (0.010, 0.015, 0.020)) -> list[dict]:
    """Recall and threshold of each model, from rows (y_true, best, confidence), within each budget of false positives."""
    out = []
    for name, df in scored.items():
        for budget in budgets:
            r = metrics.recall_at_fp(df, budget).first()
            out.append({"model": name, "budget": budget, "threshold": r["threshold"], "recall": r["recall"], "fp_rate": r["fp_rate"]})
    return out


def learning_curve(train: DataFrame, test: DataFrame, classes: list[str], sizes: tuple[int, ...], *, id_col: str, text_col: str, label: str = "label") -> list[dict]:
    """Accuracy and macro-F1 of text models learned from the first so many rows."""
    grown, out = metrics.growing_prefixes(train, sizes, id_col), []
    for n in sizes:
        own = grown.where(F.col("prefix") == n).drop("prefix")
        model = scoring.train_text(scoring.features(own, id_col, text_col).join(own.select(id_col, label), id_col), label)
        best = scoring.score_text(test, model, id_col, text_col).groupBy(id_col).agg(F.max_by("class", "score").alias("y_pred"))
        row = metrics.macro_f1(best.join(test.select(id_col, F.col(label).alias("y_true")), id_col), classes).first()
        out.append({"rows": n, "accuracy": row["accuracy"], "macro_f1": row["macro_f1"]})
    return out


def suite(expected: DataFrame, decided: DataFrame) -> DataFrame:
    """(url, ok) of a suite: expected (url, label) against decisions (url, category); only whether it is blocked counts."""
    both = expected.join(decided, "url", "left")
    return both.select("url", F.coalesce((F.col("label") == "clean") == (F.col("category") == "clean"), F.lit(False)).alias("ok"))
