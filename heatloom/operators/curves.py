"""Precision, recall and ROC curves of scored predictions, and the areas below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.session import checkpoint_root


def score_curve(rows: DataFrame) -> DataFrame:
    """One row per model and distinct score: ``(model, score, pos, neg, tp, fp, all_pos, all_neg)``.

    ``rows`` is ``(model, label, score)``; label 1 is positive, any other one negative, and rows with a null or NaN in label or
    score take no part. ``pos`` and ``neg`` are the rows with this very score, ``tp`` and ``fp`` those with this or a higher one. Rows of
    equal score are counted together before they are ordered, so a score that many rows share is one row from there on. The order
    runs over all tasks: each adds up its own range of scores, and one offset per task and model is added.
    """
    spark = rows.sparkSession
    checkpoint_root(spark)
    score, hit = F.col("score").cast("double"), F.col("label") == 1
    ties = (
        rows.filter(F.col("label").isNotNull() & score.isNotNull() & ~F.isnan(score))
        .groupBy("model", (score + 0.0).alias("score")).agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
        .repartitionByRange("model", F.col("score").desc())
        .withColumn("_pid", F.spark_partition_id()).checkpoint()
    )
    # one row per task and model
    totals = ties.groupBy("model", "_pid").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    whole = Window.partitionBy("model")
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "model", "_pid", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_fp"),
        F.sum("_p").over(whole).alias("all_pos"), F.sum("_n").over(whole).alias("all_neg"))
    inside = Window.partitionBy("model", "_pid").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = ties.withColumn("_lp", F.sum("pos").over(inside)).withColumn("_ln", F.sum("neg").over(inside))
    same = F.col("model").eqNullSafe(F.col("_model")) & (F.col("_pid") == F.col("_task"))
    joined = local.join(totals.withColumnsRenamed({"model": "_model", "_pid": "_task"}), same)
    return joined.select("model", "score", "pos", "neg", (F.col("_tp") + F.col("_lp")).alias("tp"),
                         (F.col("_fp") + F.col("_ln")).alias("fp"), "all_pos", "all_neg")


def curve_points(curve: DataFrame) -> DataFrame:
    """Recall, precision and false-positive rate at each threshold; a rate without rows to divide by is null."""
    return curve.select(
        "model", "score", F.try_divide("tp", "all_pos").alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("fp", "all_neg").alias("fpr"))


def curve_areas(curve: DataFrame) -> DataFrame:
    """Areas under the PR and ROC curves by the trapezoid rule: ``(model, pr, roc)``.

    The PR curve starts at recall 0 with the precision of the highest score. Without positive rows both areas are null, without
    negative ones the ROC area is.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    precision = tp / (tp + fp)
    last = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), precision)
    pr, roc = pos * (precision + last) / 2, neg * (2 * tp - pos) / 2
    sums = curve.groupBy("model").agg(F.sum(pr).alias("pr"), F.sum(roc).alias("roc"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n"))
    return sums.select("model", F.try_divide("pr", F.col("p")).alias("pr"), F.try_divide("roc", F.col("p") * F.col("n")).alias("roc"))


def scored_areas(rows: DataFrame) -> DataFrame:
    """``(model, pr, roc)`` from the scores of ``rows (model, label, score)``."""
    return curve_areas(score_curve(rows))
