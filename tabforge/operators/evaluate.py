"""Evaluation: classification and regression metrics, confusion matrix.

All metrics derive from one partial-aggregating ``groupBy(actual,
predicted).count()`` (classification) or one global aggregate
(regression); the arithmetic on per-class rows runs JVM-side too, so the
number of classes never passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.columns import quoted


def _q(c: str) -> Column:
    return quoted(c)


def confusion_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) for the pairs that occur."""
    return df.groupBy(_q(actual).alias("actual"), _q(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """(label, tp, support, predicted_n) from confusion counts."""
    a = counts.groupBy(F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    return (a.join(p, "label", "full_outer")
            .select("label", F.coalesce("tp", F.lit(0)).alias("tp"),
                    F.coalesce("support", F.lit(0)).alias("support"),
                    F.coalesce("predicted_n", F.lit(0)).alias("predicted_n")))


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy and support-weighted precision / recall / f1
    (a class with a zero denominator scores 0)."""
    pc = per_class(confusion_counts(df, actual, predicted))
    tp, sup, pn = F.col("tp"), F.col("support"), F.col("predicted_n")
    prec = F.when(pn > 0, tp / pn).otherwise(F.lit(0.0))
    rec = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
    f1 = F.when(sup + pn > 0, 2.0 * tp / (sup + pn)).otherwise(F.lit(0.0))
    total = F.sum(sup)
    return pc.agg(
        (F.sum(tp) / total).alias("accuracy"),
        (F.sum(sup * prec) / total).alias("precision"),
        (F.sum(sup * rec) / total).alias("recall"),
        (F.sum(sup * f1) / total).alias("f1"))


def labels_of(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> list:
    """Sorted union of the labels (bounded by the number of classes)."""
    rows = (df.select(_q(actual).alias("l")).union(df.select(_q(predicted).alias("l")))
            .where(F.col("l").isNotNull()).distinct().orderBy("l").collect())
    return [r["l"] for r in rows]


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     labels: list | None = None) -> DataFrame:
    """Long (actual, predicted, n) over every label pair, zeros included.

    The label grid is built by exploding the (class-count bounded) label
    list per actual label, then left-joined to the counts.
    """
    counts = confusion_counts(df, actual, predicted)
    labels = labels if labels is not None else labels_of(df, actual, predicted)
    if not labels:
        return counts.limit(0)
    lab = F.array(*[F.lit(v) for v in labels])
    grid = (df.sparkSession.range(1).select(F.explode(lab).alias("actual"))
            .select("actual", F.explode(lab).alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_matrix_array(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> list[list[int]]:
    """Square matrix as nested lists (rows = actual), labels sorted."""
    labels = labels_of(df, actual, predicted)
    cm = {(r["actual"], r["predicted"]): r["n"] for r in confusion_counts(df, actual, predicted).collect()}
    return [[int(cm.get((a, p), 0)) for p in labels] for a in labels]


def confusion_rates(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One-vs-rest rates per label, in percent with 1 decimal:
    TPR = tp/(tp+fn), TNR = tn/(tn+fp), FPR = fp/(tn+fp); a zero
    denominator gives NULL. For two classes the row of the second label
    is the usual binary display."""
    pc = per_class(confusion_counts(df, actual, predicted))
    # one row per class: the total over classes is a window on a tiny frame
    j = pc.withColumn("N", F.sum("support").over(Window.partitionBy()))
    tp = F.col("tp")
    fn = F.col("support") - tp
    fp = F.col("predicted_n") - tp
    tn = F.col("N") - tp - fn - fp

    def pct(num, den):
        return F.when(den > 0, F.round(num * 100.0 / den, 1))

    return j.select(F.col("label"), pct(tp, tp + fn).alias("tpr"), pct(tn, tn + fp).alias("tnr"),
                    pct(fp, tn + fp).alias("fpr"))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: r2, mse, rmse. A constant target gives r2 = 1 when the
    fit is perfect and 0 otherwise."""
    a, p = _q(actual).cast("double"), _q(predicted).cast("double")
    err = (a - p) * (a - p)
    m = df.agg(F.avg(err).alias("mse"), F.var_pop(a).alias("vt"))
    r2 = (F.when(F.col("vt") > 0, 1.0 - F.col("mse") / F.col("vt"))
          .otherwise(F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    return m.select(r2.alias("r2"), F.col("mse"), F.sqrt("mse").alias("rmse"))


def residual(actual: str = "actual", predicted: str = "predicted") -> Column:
    return (_q(actual).cast("double") - _q(predicted).cast("double")).alias("residual")


def metrics_from_counts(pairs: list[tuple]) -> dict:
    """accuracy / weighted precision, recall, f1 and the confusion matrix
    from collected (actual, predicted, n) rows — at most classes² rows,
    the size of the matrix the caller receives anyway."""
    labels = sorted({a for a, _, _ in pairs if a is not None} | {p for _, p, _ in pairs if p is not None})
    idx = {v: i for i, v in enumerate(labels)}
    k = len(labels)
    cm = [[0] * k for _ in range(k)]
    for a, p, n in pairs:
        if a is not None and p is not None:
            cm[idx[a]][idx[p]] += int(n)
    total = sum(map(sum, cm))
    out = {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0, "confusion_matrix": cm}
    if not total:
        return out
    for i in range(k):
        tp = cm[i][i]
        support = sum(cm[i])
        pred = sum(cm[r][i] for r in range(k))
        out["accuracy"] += tp / total
        out["precision"] += support * (tp / pred if pred else 0.0) / total
        out["recall"] += support * (tp / support if support else 0.0) / total
        out["f1"] += support * (2.0 * tp / (support + pred) if support + pred else 0.0) / total
    return out
