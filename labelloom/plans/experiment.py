"""Training run from labelled prompts to a stored model, and evaluation of a stored model."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.sizing import bounded_rows, spread
from labelloom.operators import features, metrics, quality, scoring, split, thresholds, training
from labelloom.operators.features import FeatureSpace
from labelloom.operators.scoring import LinearModel
from labelloom.session import work_path
from labelloom.sources import artifacts, runs


@dataclass
class Experiment:
    experiment_id: str
    algorithm: str
    model: LinearModel
    summary: DataFrame
    per_label: DataFrame
    report: list[dict]


def prepare(df: DataFrame, keyword_groups: Sequence[tuple[str, Sequence[str]]], seed: int = 42, test: float = 0.2,
            validation: float = 0.1, max_features: int = 3000, min_df: int = 1,
            ngram_range: tuple[int, int] = (1, 2)) -> tuple[DataFrame, FeatureSpace]:
    """Split, fit the feature space on the training part only, encode everything once.

    Both the split rows and the encoded rows are written to the durable folder, one partition folder
    per part: cleaning is not repeated for the second scan, every later pass prunes to its part and
    reads finished features instead of redoing the text work.
    """
    spark = df.sparkSession
    rows_path, path = work_path(spark, "parts"), work_path(spark, "encoded")
    split.with_split(df, seed, test, validation).write.partitionBy("split").parquet(rows_path)
    parts = spark.read.parquet(rows_path)
    vocabulary = features.fit_vocabulary(
        spread(parts.filter(F.col("split") == "train")), "prompt", max_features, min_df, ngram_range
    )
    space = features.space_from_vocabulary(vocabulary, keyword_groups, ngram_range)
    features.encode(spread(parts), space).withColumn("key", F.md5("prompt")).select(
        "key", "split", "y", "indices", "values"
    ).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path), space


def run_experiment(experiment_id: str, algorithm: str, encoded: DataFrame, space: FeatureSpace,
                   labels: Sequence[str], records_path: str | None = None, version: str = "unknown",
                   **options) -> Experiment:
    """Train, tune thresholds on the validation part, evaluate on the test part, record."""
    part = {s: encoded.filter(F.col("split") == s) for s in ("train", "val", "test")}
    started = time.time()
    model, report = training.fit_models(part["train"], labels, space.size, algorithm, key="key", version=version, **options)
    trained = time.time() - started
    tuned = thresholds.tune(scoring.score_vectors(part["val"], model), labels)
    model = artifacts.with_threshold_table(model, tuned)
    # The scored test rows feed both the counts and the AUC: score once, keep the small columns.
    path = work_path(encoded.sparkSession, "scored")
    started = time.time()
    scoring.score_vectors(part["test"], model).select("key", "y", "scores").write.parquet(path)
    scored = encoded.sparkSession.read.parquet(path)
    summary, per_label = metrics.evaluate(scored, labels, model.threshold_list())
    n = max(1, scored.count())
    timed = summary.withColumns(
        {
            "experiment_id": F.lit(experiment_id),
            "algorithm": F.lit(algorithm),
            "training_time_seconds": F.lit(round(trained, 3)),
            "inference_latency_ms_per_prompt": F.lit(round((time.time() - started) / n * 1000, 3)),
        }
    ).select("experiment_id", "algorithm", *runs.METRICS, *runs.TIMINGS)
    table = per_label.withColumns({"experiment_id": F.lit(experiment_id), "algorithm": F.lit(algorithm)})
    if records_path:
        runs.append_run(records_path, timed, table)
        stored = [r.filter(F.col("experiment_id") == experiment_id) for r in runs.read_runs(encoded.sparkSession, records_path)]
        timed, table = stored[0].select(*timed.columns), stored[1].select(*table.columns)
    return Experiment(experiment_id, algorithm, model, runs.recorded(timed), table, report)


def train(df: DataFrame, labels: Sequence[str], keyword_groups: Sequence[tuple[str, Sequence[str]]], out: str,
          algorithm: str = "compare", version: str = "1.0.0", source: str = "unknown", **prepare_options) -> dict:
    """Quality step, split, features, one or both algorithms, best model stored under ``out``.

    ``compare`` trains both and keeps the higher micro F1, then macro F1, the first on a tie.
    """
    spark: SparkSession = df.sparkSession
    choices = algorithms(algorithm)
    started = time.time()
    found = bounded_rows(quality.quality_report(df, labels), 3 * len(labels) + 4, "quality issues")
    issues = [r["message"] for r in sorted(found, key=lambda r: (r["check_no"], r["pos"]))]
    encoded, space = prepare(quality.clean(df, labels), keyword_groups, **prepare_options)
    best, meta = train_encoded(encoded, space, labels, out, choices, version)
    meta |= {"training_source": source, "data_quality_issues": issues, "total_training_seconds": round(time.time() - started, 2)}
    artifacts.save_model(spark, out, space, best.model, meta)
    return meta


def algorithms(algorithm: str) -> tuple[str, ...]:
    """What to train: both for ``compare``."""
    choices = training.ALGORITHMS if algorithm == "compare" else (algorithm,)
    for a in choices:
        if a not in training.ALGORITHMS:
            raise ValueError(f"Unknown algorithm: {a}")
    return choices


def train_encoded(encoded: DataFrame, space: FeatureSpace, labels: Sequence[str], out: str, choices: Sequence[str],
                  version: str = "1.0.0") -> tuple[Experiment, dict]:
    """Train the algorithms on encoded parts, record every run under ``out``; the best run and what to store of it."""
    run_id = uuid.uuid4().hex[:8]
    results = []
    for a in choices:
        suffix = "LR" if a == "logistic_regression" else "SVM"
        results.append(run_experiment(f"{run_id}_{suffix}", a, encoded, space, labels, f"{out}/experiments", version))
    rows = [e.summary.first().asDict() for e in results]
    best = max(range(len(rows)), key=lambda i: (rows[i]["micro_f1"], rows[i]["macro_f1"], -i))
    sizes = {r["split"]: r["count"] for r in encoded.groupBy("split").count().collect()}
    return results[best], {
        "run_id": run_id, "model_version": version, "algorithm": results[best].algorithm,
        "tools": list(labels), "num_tools": len(labels), "thresholds": results[best].model.thresholds,
        "train_size": sizes.get("train", 0), "val_size": sizes.get("val", 0), "test_size": sizes.get("test", 0),
        "feature_count": space.size, "training_timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "evaluation_metrics": rows[best],
        "all_experiment_results": {e.algorithm: r for e, r in zip(results, rows)},
    }


def score(df: DataFrame, space: FeatureSpace, model: LinearModel, text: str = "prompt") -> DataFrame:
    """Adds ``scores`` to prompts; batch and streaming frames alike, no shuffle."""
    return scoring.score_vectors(features.encode(df, space, text), model).drop("indices", "values")


def evaluate_stored(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Summary and per-label metrics of a stored model on any labelled (prompt, y) rows, taken as they are."""
    space, model, _ = artifacts.load_model(df.sparkSession, path)
    scored_path = work_path(df.sparkSession, "scored")
    score(df, space, model).select("y", "scores").write.parquet(scored_path)
    scored = df.sparkSession.read.parquet(scored_path)
    return metrics.evaluate(scored, model.labels, model.threshold_list())
