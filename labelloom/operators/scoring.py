"""Scoring prompts with one linear model per label."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import double_array
from labelloom.functions.sizing import MAX_LABELS, bounded_rows, small_side
from labelloom.operators import products
from labelloom.session import work_path

MAX_MODEL_CELLS = 64_000_000  # 512 MB of doubles: the largest weight matrix sent to every task
_CHUNK_CELLS = 4_000_000

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LinearModel:
    """Weights (features x members), intercepts and the way members turn into label scores.

    A label has one member (logistic regression) or several calibrated ones whose probabilities are
    averaged. ``slope``/``offset`` map a margin m to sigmoid(-(slope * m + offset)).
    """

    labels: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray
    member_label: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)
    algorithm: str = "logistic_regression"
    version: str = "unknown"

    def threshold_list(self, default: float = 0.5) -> list[float]:
        return [float(self.thresholds.get(l, default)) for l in self.labels]


def logistic_model(labels: Sequence[str], weights: np.ndarray, intercepts: np.ndarray,
                   member_label: np.ndarray | None = None, **extra) -> LinearModel:
    members = weights.shape[1]
    owner = np.arange(members) if member_label is None else np.asarray(member_label)
    return LinearModel(tuple(labels), weights, intercepts, owner, np.full(members, -1.0), np.zeros(members), **extra)


def margins(indices: np.ndarray, values: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix; ``starts`` has one more entry than there are rows."""
    n = len(starts) - 1
    out = np.zeros((n, weights.shape[1]))
    step = max(1, _CHUNK_CELLS // max(1, weights.shape[1]))
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + step, side="right")) - 1)
        end = min(end, n)
        lo, hi = starts[row], starts[end]
        filled = np.flatnonzero(np.diff(starts[row : end + 1]))
        if len(filled):
            product = weights[indices[lo:hi]] * values[lo:hi, None]
            out[row + filled] = np.add.reduceat(product, starts[row + filled] - lo, axis=0)
        row = end
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def score_vectors(df: DataFrame, model: LinearModel) -> DataFrame:
    """Adds ``scores ARRAY<DOUBLE>`` in label order; labels without a model score 0.

    Narrow: the weight matrix is broadcast if it has at most ``MAX_MODEL_CELLS``; a larger one is
    multiplied in blocks (``score_in_blocks``).
    """
    if model.weights.size > MAX_MODEL_CELLS:
        return score_in_blocks(df, model)
    shared = df.sparkSession.sparkContext.broadcast(
        (model.weights, model.intercepts, model.member_label, model.slope, model.offset, len(model.labels))
    )

    @F.arrow_udf("array<double>")
    def scores(indices: pa.Array, values: pa.Array) -> pa.Array:
        w, b, owner, slope, offset, n_labels = shared.value
        starts = indices.offsets.to_numpy()
        idx = indices.values.to_numpy(zero_copy_only=False)
        val = values.values.to_numpy(zero_copy_only=False)
        val = val[int(values.offsets[0].as_py()) - int(starts[0]) :] if starts[0] != values.offsets[0].as_py() else val
        return label_scores(margins(idx, val, starts, w), b, owner, slope, offset, n_labels)

    return df.withColumn("scores", scores("indices", "values"))


def label_scores(m: np.ndarray, b: np.ndarray, owner: np.ndarray, slope: np.ndarray, offset: np.ndarray, n_labels: int) -> pa.Array:
    """Scores of labels, a list per row, from the margins of members without intercepts."""
    p = sigmoid(-(slope * (m + b) + offset))
    total = np.zeros((len(m), n_labels))
    members = np.zeros(n_labels)
    for j, label in enumerate(owner):
        total[:, label] += p[:, j]
        members[label] += 1
    total /= np.maximum(members, 1)
    ends = np.arange(0, total.size + 1, n_labels, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))


def score_in_blocks(df: DataFrame, model: LinearModel) -> DataFrame:
    """``score_vectors`` for a matrix of any size: rows are written with a number, multiplied in blocks, and
    joined with their scores."""
    spark = df.sparkSession
    path = work_path(spark, "rows-to-score")
    df.drop("scores").withColumn("row number", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    found = products.block_margins(
        rows.select(F.col("row number").alias("row"), "indices", "values"), products.matrix_blocks(spark, model.weights))
    found = products.row_margins(found).groupBy("row").agg(products.whole_rows(found).alias("margins"))
    shared = spark.sparkContext.broadcast((model.intercepts, model.member_label, model.slope, model.offset, len(model.labels)))

    @F.arrow_udf("array<double>")
    def scores(margins: pa.Array) -> pa.Array:
        m = margins.flatten().to_numpy(zero_copy_only=False).reshape(len(margins), -1)
        return label_scores(m, *shared.value)

    scored = found.select(F.col("row").alias("scored row"), scores("margins").alias("scores"))
    return rows.join(scored, F.col("row number") == F.col("scored row")).drop("scored row", "row number")


def score_by_join(features: DataFrame, coefficients: DataFrame, intercepts: DataFrame, key: str) -> DataFrame:
    """(key, label, margin, score) from long features (key, feature, value) and tables of any size:
    coefficients (label, feature, w) and intercepts (label, b).

    Both sides are brought to blocks on the executors; a feature of a key occurs once. A key without a
    feature that has a weight gives no row, as in a join, and labels without weights give none.
    """
    spark = features.sparkSession
    labels = intercepts.join(coefficients.select("label").distinct(), "label", "left_semi").orderBy("label")
    names = [(r["label"], r["b"], i) for i, r in enumerate(bounded_rows(labels, MAX_LABELS, "labels"))]
    members = spark.createDataFrame(names, "label string, b double, member int")
    weighted = coefficients.select("feature").distinct()
    rows = features.join(weighted, "feature", "left_semi").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("feature").cast("int").alias("feature"), F.col("value").cast("double").alias(
            "value")))).alias("cells"))
    path = work_path(spark, "rows-to-score")
    rows.select(key, F.transform("cells", lambda c: c["feature"]).alias("indices"), F.transform(
        "cells", lambda c: c["value"]).alias("values"), F.monotonically_increasing_id().alias("row")).write.parquet(path)
    rows = spark.read.parquet(path)
    blocks = products.coefficient_blocks(coefficients.join(F.broadcast(members), "label"), len(names))
    found = products.row_margins(products.block_margins(rows.select("row", "indices", "values"), blocks))
    long = found.select("row", "first", F.posexplode("margins").alias("place", "dot")).withColumn("member", F.col("first") + F.col("place"))
    named = long.join(F.broadcast(members), "member").join(rows.select("row", key), "row")
    margin = F.col("dot") + F.col("b")
    return named.select(key, "label", margin.alias("margin"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("score"))


def predict(scores: Column, thresholds: Sequence[float]) -> Column:
    """0/1 vector: score >= threshold, label by label."""
    return F.zip_with(scores, double_array(thresholds), lambda s, t: (s >= t).cast("int"))


def with_thresholds(scores: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """Long scores with the threshold of their label, ``default`` where none is set."""
    return scores.join(small_side(thresholds.select("label", "threshold")), "label", "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(float(default)))
    )


def class_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(pos, label, positives, negatives, weight_pos, weight_neg, trainable): balanced weights n / (2 n_class).

    A label with one class only gets no model.
    """
    counted = df.select(F.posexplode("y").alias("pos", "v")).groupBy("pos").agg(
        F.sum("v").cast("long").alias("positives"), F.count(F.lit(1)).alias("n")
    )
    negatives = F.col("n") - F.col("positives")
    name = F.get(F.array(*[F.lit(l) for l in labels]), F.col("pos"))
    return counted.select(
        "pos",
        name.alias("label"),
        "positives",
        negatives.alias("negatives"),
        F.try_divide(F.col("n").cast("double"), F.col("positives") * 2.0).alias("weight_pos"),
        F.try_divide(F.col("n").cast("double"), negatives * 2.0).alias("weight_neg"),
        ((F.col("positives") > 0) & (negatives > 0)).alias("trainable"),
    )
