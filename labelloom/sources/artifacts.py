"""Trained models as tables: vocabulary, keywords, members, thresholds, metadata."""

from __future__ import annotations

import dataclasses
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.sizing import MAX_LABELS, bounded_rows
from labelloom.operators import products
from labelloom.operators.features import FeatureSpace
from labelloom.operators.scoring import LinearModel

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = ("terms", "keywords", "members", "labels", "meta")


class ModelNotFound(RuntimeError):
    """No complete artifact under the given path."""


def save_model(spark: SparkSession, path: str, space: FeatureSpace, model: LinearModel, meta: dict) -> None:
    """Write the artifact tables; ``meta`` comes last and marks the artifact complete.

    Weights are stored in blocks of features and members, each a row of raw doubles.
    """
    tables = {
        "terms": ([(i, t, v) for i, (t, v) in enumerate(zip(space.terms, space.idf))], "idx int, term string, idf double"),
        "keywords": (
            [(i, l, list(k)) for i, (l, k) in enumerate(space.keyword_groups)],
            "pos int, label string, keywords array<string>",
        ),
        "members": (
            [
                (j, int(model.member_label[j]), float(model.intercepts[j]), float(model.slope[j]), float(model.offset[j]))
                for j in range(model.weights.shape[1])
            ],
            "member int, label_pos int, intercept double, slope double, offset double",
        ),
        "labels": (
            [(i, l, model.thresholds.get(l)) for i, l in enumerate(model.labels)],
            "pos int, label string, threshold double",
        ),
        "meta": (
            [(model.version, model.algorithm, space.ngram_range[0], space.ngram_range[1], space.sublinear,
              space.size, json.dumps(meta, default=str))],
            "model_version string, algorithm string, ngram_low int, ngram_high int, sublinear boolean, "
            "feature_count int, details string",
        ),
    }
    blocks = products.matrix_blocks(spark, model.weights)
    blocks.write.mode("overwrite").parquet(f"{path}/weights")
    for name in TABLES:
        rows, schema = tables[name]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[FeatureSpace, LinearModel, dict]:
    """Read an artifact back; sizes are those of a model that fits a broadcast."""
    from pyspark.errors import AnalysisException

    def rows(name: str, bound: int) -> list:
        return bounded_rows(spark.read.parquet(f"{path}/{name}"), bound, name)

    try:
        meta = rows("meta", 1)[0]
    except AnalysisException as missing:
        raise ModelNotFound(f"no model under {path}") from missing
    terms = sorted(rows("terms", 1_000_000))
    keywords = sorted(rows("keywords", 1_000_000))
    members = sorted(rows("members", MAX_LABELS * 3), key=lambda r: r["member"])
    labels = sorted(rows("labels", 1_000_000))
    space = FeatureSpace(
        tuple(r["term"] for r in terms),
        tuple(r["idf"] for r in terms),
        tuple((r["label"], tuple(r["keywords"])) for r in keywords),
        (meta["ngram_low"], meta["ngram_high"]),
        meta["sublinear"],
    )
    weights = np.zeros((space.size, len(members)))
    # The matrix itself, block by block: what a driver holds that scores with it.
    for r in spark.read.parquet(f"{path}/weights").toLocalIterator():
        block = np.frombuffer(r["matrix"]).reshape(-1, r["members"])
        at = r["slice"] * products.FEATURES
        weights[at:at + len(block), r["first"]:r["first"] + r["members"]] = block
    model = LinearModel(
        tuple(r["label"] for r in labels),
        weights,
        np.array([r["intercept"] for r in members]),
        np.array([r["label_pos"] for r in members], int),
        np.array([r["slope"] for r in members]),
        np.array([r["offset"] for r in members]),
        {r["label"]: r["threshold"] for r in labels if r["threshold"] is not None},
        meta["algorithm"],
        meta["model_version"],
    )
    return space, model, json.loads(meta["details"])


def coefficient_table(spark: SparkSession, path: str) -> DataFrame:
    """(member, label_pos, idx, w) rows of a stored model, unpacked on the executors, for scoring by join."""
    width = products.FEATURES

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = np.frombuffer(r["matrix"]).reshape(-1, r["members"])
                idx, member = np.indices(block.shape, np.int32)
                yield pa.RecordBatch.from_pydict({
                    "member": member.ravel() + np.int32(r["first"]), "idx": idx.ravel() + np.int32(r["slice"] * width),
                    "w": block.ravel()})

    found = spark.read.parquet(f"{path}/weights").mapInArrow(cells, "member int, idx int, w double")
    owners = spark.read.parquet(f"{path}/members").select("member", "label_pos")
    return found.join(owners, "member").select("member", "label_pos", "idx", "w")


def with_threshold_table(model: LinearModel, thresholds: DataFrame) -> LinearModel:
    rows = bounded_rows(thresholds.select("label", "threshold"), 1_000_000, "thresholds")
    return dataclasses.replace(model, thresholds={r["label"]: float(r["threshold"]) for r in rows})
