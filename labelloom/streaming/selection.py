"""Selection and routing over a stream of prompts.

Every step is a per-row expression against a model fixed at start, so the stream needs no state,
no watermark and no shuffle; a lost executor only repeats its part of a micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom.operators import routing, selection
from labelloom.operators.features import FeatureSpace
from labelloom.operators.scoring import LinearModel
from labelloom.plans.experiment import score


def decide(prompts: DataFrame, space: FeatureSpace, model: LinearModel, policy: routing.Policy,
           key: str = "prompt_id") -> DataFrame:
    """Prompts (key, prompt[, request_id]) to scored, selected and routed rows."""
    given = F.col("request_id") if "request_id" in prompts.columns else None
    rows = prompts.withColumn("request_id", selection.request_id(given, F.coalesce("prompt", F.lit("")), F.col(key)))
    scored = score(rows, space, model)
    chosen = selection.select_labels(scored, model.labels, model.threshold_list())
    routed = routing.route(chosen, model.labels, policy, selection.tools_of("selected"))
    return routed.withColumns({"model_version": F.lit(model.version), "algorithm": F.lit(model.algorithm)})


def start(prompts: DataFrame, space: FeatureSpace, model: LinearModel, policy: routing.Policy, out: str,
          checkpoint: str, key: str = "prompt_id", **trigger) -> StreamingQuery:
    """Write decisions of a streaming frame to Parquet, exactly once per input row."""
    decided = decide(prompts, space, model, policy, key).drop("scores")
    writer = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
