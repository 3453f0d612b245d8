"""Quality of category decisions: recall, precision, false positives, sweeps and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Percentage points by which false positives may rise, and recall fall, before a gate closes.
FP_MARGIN, RECALL_MARGIN = 1.0, 3.0
TEXT_THRESHOLDS = (0.50, 0.70, 0.80, 0.90, 0.95, 0.99)
TREE_THRESHOLDS = (0.90, 0.93, 0.95, 0.97, 0.98, 0.99)


def _count(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(label, precision, recall, support) of every label asked for, from rows (y_true, y_pred).

    A row counts for its true and for its predicted label; one pass, partially summed.
    """
    t, p = F.col("y_true"), F.col("y_pred")
    sides = F.array(F.struct(t.alias("label"), F.lit(1).alias("of"), (t == p).cast("int").alias("hit")), F.struct(p.alias("label"), F.lit(0).alias("of"), (t == p).cast("int").alias("hit")))
    each = rows.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(_count((F.col("of") == 1) & (F.col("hit") == 1)).alias("tp"), _count(F.col("of") == 1).alias("support"), _count(F.col("of") == 0).alias("predicted"))
    asked = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    full = F.broadcast(asked).join(each, "label", "left").na.fill(0)
    return full.select("label", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), "support")


def fp_rate(rows: DataFrame, clean: str) -> DataFrame:
    """(fp_rate): the share of clean rows that are flagged, 0 without clean rows."""
    own = F.col("y_true") == clean
    return rows.agg(_ratio(_count(own & (F.col("y_pred") != clean)), _count(own)).alias("fp_rate"))


def measure(rows: DataFrame, categories: list[str], clean: str = "clean") -> DataFrame:
    """One row: clean totals and false positives; per category how many there are, are blocked, blocked as themselves and predicted; blocked as another."""
    t, p = F.col("y_true"), F.col("y_pred")
    blocked = p != clean
    out = [F.count("*").alias("n"), _count(t == clean).alias("clean_total"), _count((t == clean) & blocked).alias("clean_fp")]
    for c in categories:
        name = c.replace("-", "_")
        out += [_count(t == c).alias(f"total_{name}"), _count((t == c) & blocked).alias(f"detected_{name}"), _count((t == c) & (p == c)).alias(f"exact_{name}"), _count(p == c).alias(f"predicted_{name}")]
    out.append(_count(t.isin(*categories) & blocked & (p != t)).alias("wrong_category"))
    one = rows.agg(*out)
    for c in categories:
        name = c.replace("-", "_")
        one = one.withColumn(f"recall_{name}", _ratio(F.col(f"detected_{name}"), F.col(f"total_{name}"))).withColumn(f"exact_recall_{name}", _ratio(F.col(f"exact_{name}"), F.col(f"total_{name}")))
        one = one.withColumn(f"precision_{name}", _ratio(F.col(f"exact_{name}"), F.col(f"predicted_{name}")))
    return one.withColumn("clean_fp_rate", _ratio(F.col("clean_fp"), F.col("clean_total")))


def sweep(scored: DataFrame, thresholds: tuple[float, ...], clean: str = "clean") -> DataFrame:
    """(threshold, fp_rate, recall) of rows (y_true, best, confidence), blocked where the confidence reaches the threshold.

    Rows are counted once per true label and number of thresholds reached; the few counts then meet the thresholds.
    """
    reached = F.lit(0)
    for x in thresholds:
        reached = reached + (F.col("confidence") >= x).cast("int")
    each = scored.groupBy((F.col("y_true") == clean).alias("clean"), F.coalesce(reached, F.lit(0)).alias("reached")).agg(F.count("*").alias("n"))
    spark = scored.sparkSession
    table = spark.createDataFrame([(float(x), i + 1) for i, x in enumerate(sorted(thresholds))], "threshold double, place int")
    hit = F.col("reached") >= F.col("place")
    out = F.broadcast(table).join(each, F.lit(True), "left").groupBy("threshold").agg(
        F.sum(F.when(F.col("clean") & hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("clean"), F.col("n")).otherwise(0)).alias("negatives"),
        F.sum(F.when(~F.col("clean") & hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("clean"), F.col("n")).otherwise(0)).alias("positives"),
    )
    return out.select("threshold", _ratio(F.col("fp"), F.col("negatives")).alias("fp_rate"), _ratio(F.col("tp"), F.col("positives")).alias("recall"))


def budget_thresholds(n: int = 140, low: float = 0.30, high: float = 0.995) -> tuple[float, ...]:
    return tuple(low + (high - low) * i / (n - 1) for i in range(n))


def recall_at_fp(scored: DataFrame, budget: float, clean: str = "clean") -> DataFrame:
    """The threshold with the best recall among those within the budget of false positives, the least on ties; the highest one if none is."""
    every = sweep(scored, budget_thresholds(), clean)
    last = budget_thresholds()[-1]
    fits = F.col("fp_rate") <= budget
    return every.where(fits | (F.abs(F.col("threshold") - last) < 1e-12)).orderBy(F.desc(fits), F.desc("recall"), "threshold").limit(1)


def macro_f1(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(accuracy, macro_f1) over the labels."""
    c = per_class(rows, labels)
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    accuracy = rows.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return accuracy.join(c.agg(F.avg(f1).alias("macro_f1")))


def bakeoff(rows: DataFrame, scored: DataFrame, labels: list[str], threshold: float = 0.9, clean: str = "clean") -> DataFrame:
    """(accuracy, macro_f1, fp_rate, recall): labels of the best class, and blocking where the best blocked class reaches the threshold."""
    return macro_f1(rows, labels).join(sweep(scored, (threshold,), clean).select("fp_rate", "recall"))


#: Names and rounding of the figures are a file format.
def baseline(measured: dict, categories: list[str]) -> dict:
    """What a gate holds later results against: observed figures, a ceiling and floors."""
    recall = {c: measured[f"recall_{c.replace('-', '_')}"] for c in categories}
    return {
        "n": measured["n"],
        "observed": {"clean_fp_rate": round(measured["clean_fp_rate"], 4), "detection_recall": {c: round(r, 4) for c, r in recall.items()}},
        "clean_fp_ceiling": round(measured["clean_fp_rate"] + FP_MARGIN / 100, 4),
        "recall_floor": {c: round(max(0.0, r - RECALL_MARGIN / 100), 4) for c, r in recall.items()},
    }


def gate(measured: dict, base: dict) -> list[str]:
    """What fails: a rate above its ceiling, recalls below their floors."""
    out = [f"clean_fp_rate {measured['clean_fp_rate']:.4f} > {base['clean_fp_ceiling']}"] if measured["clean_fp_rate"] > base["clean_fp_ceiling"] else []
    for c, floor in base["recall_floor"].items():
        got = measured[f"recall_{c.replace('-', '_')}"]
        if got < floor:
            out.append(f"recall of {c} {got:.4f} < {floor}")
    return out


def growing_prefixes(rows: DataFrame, sizes: tuple[int, ...], seq: str) -> DataFrame:
    """`rows` once per size that it is among the first of, with the column prefix; for learning curves."""
    n = rows.withColumn("n", F.row_number().over(Window.orderBy(seq))).where(F.col("n") <= max(sizes))
    return n.withColumn("prefix", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("n")))).drop("n")


def compare_verdicts(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(file, ok): expected verdicts (file, block, pin) against observed ones; one that is missing on a side is not ok."""
    e, o = expected.select("file", F.col("block").alias("eb"), F.col("pin").alias("ep")), observed.select("file", F.col("block").alias("ob"), F.col("pin").alias("op"))
    return e.join(o, "file", "full_outer").select("file", F.coalesce(F.col("eb").eqNullSafe(F.col("ob")) & F.col("ep").eqNullSafe(F.col("op")), F.lit(False)).alias("ok"))
