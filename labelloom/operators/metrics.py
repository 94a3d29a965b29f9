"""Multi-label evaluation from rows with ``y`` and ``scores`` vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.columns import double_array, ratio, str_array
from labelloom.operators.scoring import predict
from labelloom.operators.thresholds import label_cells

ROW = -1


def confusion(df: DataFrame, labels: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(pos, label, threshold, tp, fp, tn, fn); position -1 counts whole prompts (tp = all labels right).

    One aggregation keyed by label position: a task ships one row per label, whatever it read.
    """
    pred = predict(F.col("scores"), thresholds)
    rows = df.select("y", pred.alias("pred"))
    exact = F.forall(F.zip_with("y", "pred", lambda a, b: a == b), lambda same: same).cast("int")
    cells = F.concat(
        F.array(F.struct(F.lit(ROW).alias("pos"), F.lit(1).alias("y"), exact.alias("pred"))),
        F.transform(
            F.arrays_zip(F.col("y").alias("y"), F.col("pred").alias("pred")),
            lambda c, i: F.struct(i.alias("pos"), c["y"].alias("y"), c["pred"].alias("pred")),
        ),
    )
    long = rows.select(F.explode_outer(cells).alias("c")).select("c.*")

    def count(y: int, p: int) -> Column:
        return F.count_if((F.col("y") == y) & (F.col("pred") == p))

    return long.groupBy("pos").agg(
        count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn")
    ).select(
        "pos",
        F.when(F.col("pos") >= 0, F.get(str_array(labels), F.col("pos"))).alias("label"),
        F.when(F.col("pos") >= 0, F.get(double_array(thresholds), F.col("pos"))).alias("threshold"),
        "tp", "fp", "tn", "fn",
    )


def _prf(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(tp * 2.0, tp * 2 + fp + fn))
    )


def per_label(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label from confusion counts; an empty denominator gives 0."""
    return _prf(counts.filter(F.col("pos") >= 0))


def roc_auc(df: DataFrame, labels: Sequence[str], single_class_null: bool = True) -> DataFrame:
    """(pos, label, auc): Mann-Whitney with ties counted half, exact.

    Equal scores are counted first. The counts are then range partitioned by label and score, so that
    cells hold equally many distinct scores however crowded some part of the range is: pairs inside a
    cell come from a window over that cell only, pairs across cells from a running sum over cell
    totals. No task ever holds all scores of a label.
    """
    counts = (
        label_cells(df.select("y", F.col("scores").alias("score")), "y", "score")
        .groupBy("pos", "score")
        .agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))
        .repartitionByRange("pos", "score")
        .withColumn("cell", F.spark_partition_id())
    )
    inside = W.partitionBy("pos", "cell").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(inside), F.lit(0.0))
    cells = counts.withColumn("u", F.col("p") * (below + F.col("n") * 0.5)).groupBy("pos", "cell").agg(
        F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n")
    )
    earlier = W.partitionBy("pos").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("n").over(earlier), F.lit(0.0))
    total = cells.withColumn("u", F.col("u") + F.col("p") * lower).groupBy("pos").agg(
        F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n")
    )
    auc = ratio(F.col("u"), F.col("p") * F.col("n"), None)
    if not single_class_null:
        # Without the guard an all-positive label has no negatives to rank against either: 0/0.
        auc = F.when(F.col("p") > 0, F.coalesce(auc, F.lit(float("nan"))))
    return total.select("pos", F.get(str_array(labels), F.col("pos")).alias("label"), auc.alias("auc"))


def summary(counts: DataFrame) -> DataFrame:
    """One row of pooled metrics from confusion counts."""
    scored = _prf(counts).withColumn("support", F.col("tp") + F.col("fn"))
    lab = F.col("pos") >= 0

    def total(column: Column) -> Column:
        return F.sum(F.when(lab, column))

    tp, fp, tn, fn = (total(F.col(c)) for c in ("tp", "fp", "tn", "fn"))
    prompts = F.sum(F.when(~lab, F.col("tp") + F.col("fn")))
    exact = F.sum(F.when(~lab, F.col("tp")))
    return scored.agg(
        ratio(tp * 2.0, tp * 2 + fp + fn).alias("micro_f1"),
        F.avg(F.when(lab, F.col("f1"))).alias("macro_f1"),
        ratio(total(F.col("f1") * F.col("support")), total(F.col("support"))).alias("weighted_f1"),
        ratio(tp, tp + fp).alias("micro_precision"),
        ratio(tp, tp + fn).alias("micro_recall"),
        ratio(exact, prompts).alias("exact_match"),
        ratio(tp, tp + fp, None).alias("tool_selection_accuracy"),
        ratio(tn, tn + fn, None).alias("tool_rejection_accuracy"),
        F.coalesce(F.lit(1.0) - ratio(tp + fp, tp + fp + tn + fn, None), F.lit(0.0)).alias("tool_reduction"),
        ratio(tp + fp, prompts).alias("avg_tools_per_prompt"),
    )


def evaluate(df: DataFrame, labels: Sequence[str], thresholds: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(summary, per-label table with AUC) of scored rows."""
    counts = confusion(df, labels, thresholds)
    table = per_label(counts).join(roc_auc(df, labels).select("pos", "auc"), "pos", "left")
    return summary(counts), table
