"""Experiment records: one row per run, one row per run and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = (
    "micro_f1", "macro_f1", "weighted_f1", "micro_precision", "micro_recall", "exact_match",
    "tool_selection_accuracy", "tool_rejection_accuracy", "tool_reduction", "avg_tools_per_prompt",
)
TIMINGS = ("training_time_seconds", "inference_latency_ms_per_prompt")

_LABEL = (
    "struct<threshold:double,precision:double,recall:double,f1:double,auc:double,"
    "tp:bigint,fp:bigint,tn:bigint,fn:bigint>"
)
RECORD_SCHEMA = (
    ", ".join(f"{m} double" for m in METRICS + TIMINGS)
    + f", algorithm string, experiment_id string, per_tool map<string,{_LABEL}>"
)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Per-run JSON documents as rows with a ``per_tool`` map."""
    return spark.read.schema(RECORD_SCHEMA).json(path, multiLine=True)


def runs_of(records: DataFrame) -> DataFrame:
    return records.select("experiment_id", "algorithm", *METRICS, *TIMINGS)


def run_labels_of(records: DataFrame) -> DataFrame:
    return records.select("experiment_id", "algorithm", F.explode("per_tool").alias("label", "m")).select(
        "experiment_id", "algorithm", "label", "m.*"
    )


def recorded(df: DataFrame) -> DataFrame:
    """Metrics as a run record holds them: four digits; comparisons use the record."""
    names = [c for c in (*METRICS, "precision", "recall", "f1", "auc") if c in df.columns]
    return df.withColumns({c: F.round(c, 4) for c in names})


def append_run(path: str, summary: DataFrame, per_label: DataFrame) -> None:
    """Add a run to the two run tables under ``path``."""
    recorded(summary).write.mode("append").partitionBy("experiment_id").parquet(f"{path}/runs")
    recorded(per_label).write.mode("append").partitionBy("experiment_id").parquet(f"{path}/run_label_metrics")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/run_label_metrics")


def best_run(runs: DataFrame) -> DataFrame:
    """Highest recorded micro F1, then macro F1; the earliest ``run_no`` on a full tie."""
    runs = recorded(runs)
    best = F.max_by(F.struct(*runs.columns), F.struct("micro_f1", "macro_f1", (-F.col("run_no")).alias("r")))
    return runs.agg(best.alias("b")).select("b.*")


def weak_labels(run_labels: DataFrame) -> DataFrame:
    """Per run: labels without signal (F1 = 0) and labels that never occur as positives."""
    return run_labels.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(F.col("f1") == 0).alias("labels_f1_zero"),
        F.count_if(F.col("f1") > 0).alias("labels_with_signal"),
        F.count_if((F.col("tp") + F.col("fn")) == 0).alias("labels_without_positives"),
    )
