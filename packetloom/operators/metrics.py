"""Scores from confusion counts, in plain aggregations.

A predictions table of any size is first reduced to one row per (truth, prediction);
everything after that is tiny. Division by zero counts as 0. Macro and weighted
averages run over the classes seen in truth or prediction, per-class tables over the
class list that is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def confusion_counts(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame, by: Sequence[str] = (), classes: DataFrame | None = None) -> DataFrame:
    """precision, recall, f1 and support per class, from :func:`confusion_counts`.

    ``classes`` (column ``class``) fixes the class list; else it is what was seen.
    """
    truth = counts.select(*by, F.col("y_true").alias("class"), F.col("n").alias("support"), F.lit(0).alias("guessed"),
                          F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits"))
    guess = counts.select(*by, F.col("y_pred").alias("class"), F.lit(0).alias("support"), F.col("n").alias("guessed"),
                          F.lit(0).alias("hits"))
    seen = truth.unionByName(guess).groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "guessed", "hits")]
    )
    if classes is not None:
        parts = counts.select(*by).distinct() if by else None
        grid = classes.select("class") if parts is None else parts.crossJoin(classes.select("class"))
        seen = grid.join(seen, [*by, "class"], "left").fillna(0, ["support", "guessed", "hits"])
    c = F.col
    return seen.select(
        *by, "class", _ratio(c("hits"), c("guessed")).alias("precision"),
        _ratio(c("hits"), c("support")).alias("recall"),
        _ratio(2 * c("hits"), c("guessed") + c("support")).alias("f1"), "support",
    )


def overall(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro_f1, weighted_f1 and rows."""
    hits = counts.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("_hits"),
    )
    scores = per_class(counts, by).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    joined = hits.join(scores, list(by)) if by else hits.crossJoin(scores)
    return joined.select(
        *by, _ratio(F.col("_hits"), F.col("rows")).alias("accuracy"), "macro_f1", "weighted_f1", "rows"
    )


def confusion_matrix(counts: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Wide matrix: a row per true class, a column per predicted one, both complete."""
    spark = counts.sparkSession
    rows = spark.createDataFrame([(c,) for c in classes], "y_true string")
    wide = counts.groupBy("y_true").pivot("y_pred", list(classes)).agg(F.sum("n"))
    return rows.join(wide, "y_true", "left").fillna(0, list(classes))


def confusion_long(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Full truth × prediction grid of the given classes with zeros."""
    grid = classes.select(F.col("class").alias("y_true")).crossJoin(classes.select(F.col("class").alias("y_pred")))
    return grid.join(counts, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def wide_f1(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per-class F1 with one column per model, plus the support."""
    return scores.groupBy("class").pivot("model", list(models)).agg(F.max("f1")).join(
        scores.groupBy("class").agg(F.max("support").alias("support")), "class"
    )


def best_epoch(history: DataFrame, patience: int, by: Sequence[str] = ()) -> DataFrame:
    """Best epoch under early stopping: strictly better scores reset the patience."""
    order = Window.partitionBy(*by).orderBy("epoch")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max("val_macro_f1").over(so_far)
    marked = history.withColumn(
        "_improved", best_before.isNull() | (F.col("val_macro_f1") > best_before)
    ).withColumn("_last_best", F.max(F.when(F.col("_improved"), F.col("epoch"))).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when(F.col("epoch") - F.col("_last_best") >= patience, F.col("epoch"))).over(
        Window.partitionBy(*by))
    run = marked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return run.groupBy(*by).agg(
        F.max_by("epoch", F.when(F.col("_improved"), F.col("epoch"))).alias("best_epoch"),
        F.max("val_macro_f1").alias("best_val_macro_f1"), F.max("epoch").alias("stopped_at"),
    )
