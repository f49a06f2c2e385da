"""Classification metrics from (label, prediction) rows, and safety-first model selection.

Everything starts from the long confusion table (label, prediction, n): one
aggregate over the predictions; the rest works on at most k^2 rows for k
classes.  Classes are the union of labels and predictions; empty divisions
give 0 (zero_division=0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as K


def confusion_long(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(cm_long: DataFrame, classes: list[str] = K.CLASSES) -> DataFrame:
    """Wide confusion matrix: one row per true label, one column per predicted class."""
    return cm_long.groupBy("label").pivot("prediction", classes).agg(F.sum("n")).na.fill(0, subset=classes)


def per_class(cm_long: DataFrame) -> DataFrame:
    """Per class: support, predicted, tp, precision, recall, f1."""
    by_label = cm_long.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))).alias("tp"))
    by_pred = cm_long.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    j = by_label.join(by_pred, "class", "full_outer").select(
        "class", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["support", "predicted", "tp"]])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def summary(cm_long: DataFrame, critical: str = K.CRITICAL) -> DataFrame:
    """One row: n, accuracy, macro precision / recall / f1, critical-class recall."""
    pc = per_class(cm_long)
    return pc.agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.coalesce(F.max(F.when(F.col("class") == critical, F.col("recall"))), F.lit(0.0)).alias("critical_recall"))


def classification_report(cm_long: DataFrame) -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg' rows (precision, recall, f1, support)."""
    pc = per_class(cm_long)
    cls = pc.select(F.col("class").alias("row"), "precision", "recall", "f1", "support")
    tot = F.sum("support")
    macro = pc.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   tot.alias("support")).select(F.lit("macro avg").alias("row"), "*")
    weighted = pc.agg(*[(F.sum(F.col(m) * F.col("support")) / tot).alias(m) for m in ["precision", "recall", "f1"]],
                      tot.alias("support")).select(F.lit("weighted avg").alias("row"), "*")
    return cls.unionByName(macro).unionByName(weighted)


def compare(metrics: dict[str, DataFrame], cross: dict[str, DataFrame] | None = None) -> DataFrame:
    """Side-by-side table: one row per model (``metrics`` maps name -> one-row summary), in given order.

    ``cross`` maps names to the summary of the out-of-fold predictions: cv_accuracy, cv_f1, cv_critical_recall.
    """
    out = None
    for i, (name, m) in enumerate(metrics.items()):
        row = m.select(F.lit(name).alias("model"), F.lit(i).alias("priority"), "*")
        if cross and name in cross:
            cv = cross[name].select(*[F.col(c).alias(f"cv_{c}") for c in ("accuracy", "f1", "critical_recall")])
            row = row.join(F.broadcast(cv))  # one row each
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def select_best(comparison: DataFrame) -> DataFrame:
    """Safety-first choice: max (critical_recall, f1, accuracy); ties go to the earlier model."""
    key = F.struct(F.col("critical_recall"), F.col("f1"), F.col("accuracy"), (-F.col("priority")).alias("p"))
    return comparison.agg(F.max_by("model", key).alias("best_model"),
                          F.max(key).getField("critical_recall").alias("critical_recall"),
                          F.max(key).getField("f1").alias("f1"),
                          F.max(key).getField("accuracy").alias("accuracy"))


def argmax_label(probs: list, classes: list[str] = K.CLASSES):
    """(label, confidence) columns: highest probability, ties to the first class in ``classes`` order."""
    arr = F.array(*probs)
    idx = F.array_position(arr, F.array_max(arr))
    return F.element_at(F.array(*[F.lit(c) for c in classes]), idx.cast("int")), F.array_max(arr)


def class_weights(df: DataFrame, label: str = "risk_label") -> DataFrame:
    """Balanced class weight n / (k * n_c) per class (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    return (counts.join(F.broadcast(one))  # one row of totals
            .withColumn("weight", F.col("_rows") / (F.col("_classes") * F.col("n"))).drop("_rows", "_classes"))


def percent_text(x) -> F.Column:
    """Confidence as text with one decimal and a percent sign (half up, same in every engine)."""
    k = F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("long")
    return F.concat((k / 10).cast("long").cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("%"))
