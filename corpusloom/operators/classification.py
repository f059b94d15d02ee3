"""Class balance, classification metrics, weighted loss.

All sums are pre-aggregated per task; what follows works on at most
classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.arrays import log_normaliser
from corpusloom.functions.numbers import whole
from corpusloom.operators.sampling import draw_with_replacement


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = float(beta) ** 2
    return _ratio((1 + b2) * precision * recall, b2 * precision + recall)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n, pct)``."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def class_weights(df: DataFrame, num_classes: int, label: str = "label") -> DataFrame:
    """Inverse frequency weight of each class ``0 .. num_classes - 1``; 0 for an absent one.

    A label outside that range fails the job.
    """
    message = F.concat(F.lit("label out of range: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
    known = F.col(label).between(0, num_classes - 1)
    checked = class_distribution(df, label).withColumn(
        label, F.when(known, F.col(label)).otherwise(F.raise_error(message).cast("long"))
    )
    weighted = checked.withColumn("weight", df.agg(F.count(F.lit(1))).scalar() / (num_classes * F.col("n")))
    classes = df.sparkSession.range(num_classes).select(F.col("id").alias(label))
    return classes.join(weighted, label, "left").select(
        label,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
    )


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each row's label; ``weights`` has one row per class, and Spark weighs its size before it is shared."""
    return df.join(weights.select(label, "weight"), label, "left")


def align_predictions(predictions: DataFrame, labels: DataFrame, key: str = "ex_id") -> DataFrame:
    return predictions.join(labels, key)


def class_universe(df: DataFrame) -> DataFrame:
    """Classes seen as label or as prediction: one column ``cls``."""
    return confusion_counts(df).select(F.explode(F.array("label", "pred")).alias("cls")).distinct()


def confusion_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(label, pred, n)`` for the pairs that occur."""
    return df.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """``(label, pred, n)`` for the pairs that occur; over all pairs of ``classes``, zeros included, if these are given.

    Labels and predictions outside a given list are left out with their pairs.
    """
    counts = confusion_counts(df, by)
    if classes is None:
        return counts
    listed = F.array(*[F.lit(c).cast("long") for c in classes])
    grid = F.explode(F.flatten(F.transform(listed, lambda a: F.transform(listed, lambda b: F.struct(a.alias("label"), b.alias("pred"))))))
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    cells = groups.select(*by, grid.alias("cell")).select(*by, "cell.label", "cell.pred")
    zeros = cells.withColumn("n", F.lit(0).cast("long"))
    inside = counts.where(F.col("label").isin(*classes) & F.col("pred").isin(*classes))
    return inside.unionByName(zeros).groupBy(*by, "label", "pred").agg(F.sum("n").alias("n"))


def class_sums(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tp``, ``support`` and ``predicted`` per class (and per ``by``)."""
    hit = (F.col("label") == F.col("pred")).cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").cast("long").alias("cls"), hit.alias("tp"), one.alias("is_true"), none.alias("is_pred")),
        F.struct(F.col("pred").cast("long").alias("cls"), none.alias("tp"), none.alias("is_true"), one.alias("is_pred")),
    )
    return (
        df.select(*by, F.explode(sides).alias("side"))
        .groupBy(*by, F.col("side.cls").alias("cls"))
        .agg(
            F.sum("side.tp").alias("tp"),
            F.sum("side.is_true").alias("support"),
            F.sum("side.is_pred").alias("predicted"),
        )
    )


def class_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, F2, support and accuracy of each class."""
    return _report(class_sums(df, by), by)


def class_report_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`class_report` from ``(by, label, pred, n)``."""
    hits = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("cls"), hits.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    spread = counts.select(*by, F.inline(sides))
    return _report(spread.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]), by)


def _report(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    scored = sums.select(
        *by,
        F.col("cls").alias("label"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        "support",
    )
    return scored.select(
        *by,
        "label",
        "precision",
        "recall",
        f_beta(F.col("precision"), F.col("recall"), 1).alias("f1"),
        f_beta(F.col("precision"), F.col("recall"), 2).alias("f2"),
        "support",
        F.col("recall").alias("accuracy"),
    )


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("label") == F.col("pred")).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def macro_and_weighted(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by``: plain and support-weighted means over the classes."""
    scores = ("precision", "recall", "f1", "f2")
    total = F.sum("support")
    return report.groupBy(*by).agg(
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[(F.sum(F.col(s) * F.col("support")) / total).alias(f"weighted_{s}") for s in scores],
        (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
        total.alias("support"),
    )


def overall_report(df: DataFrame) -> DataFrame:
    """``(metric, value)`` in long form. Accuracy is the support-weighted recall."""
    means = macro_and_weighted(class_report(df)).withColumn("support", F.col("support").cast("double"))
    return means.unpivot([], means.columns, "metric", "value")


def draw_batches(df: DataFrame, key: str, batches: int, batch_size: int, seed: int) -> DataFrame:
    """``batches`` batches of rows drawn with replacement: ``batch_id`` and the row."""
    drawn = draw_with_replacement(df, key, batches * batch_size, seed)
    return drawn.select(whole(F.col("draw"), batch_size).alias("batch_id"), *df.columns)


def batch_mean_metrics(drawn: DataFrame) -> DataFrame:
    """Metrics of each batch, then their means; not the metric of all rows together.

    ``mean_loss`` is there if the rows have ``logits``.
    """
    per_batch = macro_and_weighted(class_report(drawn, ["batch_id"]), ["batch_id"])
    means = [F.avg("accuracy").alias("mean_accuracy"), F.avg("macro_f2").alias("mean_f2")]
    if "logits" in drawn.columns:
        per_batch = per_batch.join(mean_loss(drawn, ["batch_id"]), "batch_id")
        means.insert(0, F.avg("loss").alias("mean_loss"))
    return per_batch.agg(F.count(F.lit(1)).alias("batches"), *means)


def row_loss(logits: Column, label: Column) -> Column:
    """Cross-entropy of a row: the negative log-probability of its label."""
    return log_normaliser(logits) - F.element_at(logits, (label + 1).cast("int"))


def mean_loss(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, loss)``: mean cross-entropy; null for groups without logits."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col("logits").isNotNull(), row_loss(F.col("logits"), F.col("label")))).alias("loss"))


def weighted_cross_entropy(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weighted losses over the sum of weights: ``loss``. Needs ``logits`` and ``label``."""
    rows = attach_weights(df.select("label", "logits"), weights)
    nll = row_loss(F.col("logits"), F.col("label"))
    return rows.select("weight", nll.alias("nll")).agg(
        (F.sum(F.col("weight") * F.col("nll")) / F.sum("weight")).alias("loss")
    )
