"""Per-label thresholds: sweep, floor, overrides, configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import double_array, ratio, str_array
from labelloom.functions.sizing import MAX_LABELS, bounded_rows

CUTS = tuple(round(0.10 + 0.05 * i, 2) for i in range(17))
DEFAULT = 0.5


def label_cells(df: DataFrame, *columns: str) -> DataFrame:
    """(pos, columns..): the vectors of a row, one row per label."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return df.select(F.posexplode(zipped).alias("pos", "c")).select("pos", *[f"c.{c}" for c in columns])


def tune(
    df: DataFrame,
    labels: Sequence[str],
    cuts: Sequence[float] = CUTS,
    floor: float = 0.30,
    default: float = DEFAULT,
) -> DataFrame:
    """(pos, label, threshold, best_f1, swept) from rows with ``y`` and ``scores``.

    Scores are reduced to the number of cut-offs they reach, so the shuffle carries at most
    (cuts + 1) rows per label and task. The lowest cut-off with the best F1 wins, then the floor
    applies; a label with one class keeps the default.
    """
    reached = sum(((F.col("scores") >= F.lit(float(c))).cast("int") for c in cuts), F.lit(0))
    cells = (
        label_cells(df, "y", "scores")
        .groupBy("pos", reached.alias("reached"))
        .agg(F.sum("y").cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    )

    def at(i: int, column: str) -> Column:
        return F.sum(F.when(F.col("reached") > i, F.col(column)).otherwise(0))

    folded = cells.groupBy("pos").agg(
        F.sum("p").alias("positives"),
        F.sum("n").alias("n"),
        F.array(*[at(i, "p") for i in range(len(cuts))]).alias("tp"),
        F.array(*[at(i, "n") for i in range(len(cuts))]).alias("sel"),
    )
    f1 = F.transform(
        F.arrays_zip(F.col("tp").alias("tp"), F.col("sel").alias("sel"), double_array(cuts).alias("t")),
        lambda c: F.struct(
            ratio(c["tp"] * 2.0, c["sel"] + F.col("positives")).alias("f1"), (-c["t"]).alias("neg_t")
        ),
    )
    swept = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    best = folded.select("pos", swept.alias("swept"), F.array_max(f1).alias("b"))
    return best.select(
        "pos",
        F.get(str_array(labels), F.col("pos")).alias("label"),
        F.when(F.col("swept"), F.greatest(-F.col("b.neg_t"), F.lit(float(floor)))).otherwise(float(default)).alias("threshold"),
        F.when(F.col("swept"), F.col("b.f1")).alias("best_f1"),
        "swept",
    )


def override(thresholds: DataFrame, manual: DataFrame, note: str = "manual override") -> DataFrame:
    """Thresholds replaced from a (label, threshold) table, with a note on the replaced ones."""
    side = manual.select("label", F.col("threshold").alias("manual"))
    return thresholds.join(side, "label", "left").select(
        "label",
        F.coalesce("manual", "threshold").alias("threshold"),
        F.when(F.col("manual").isNotNull(), F.lit(note)).alias("note"),
    )


def configured(catalog: DataFrame, config: DataFrame, default: float = DEFAULT) -> DataFrame:
    """(label, threshold, valid): the configured value or the default; valid means strictly in (0, 1)."""
    value = F.coalesce("threshold", F.lit(float(default)))
    return catalog.select("label").join(config.select("label", "threshold"), "label", "left").select(
        "label", value.alias("threshold"), ((value > 0) & (value < 1)).alias("valid")
    )


def threshold_list(thresholds: DataFrame, labels: Sequence[str], default: float = DEFAULT) -> list[float]:
    """Thresholds in label order for row-wise use."""
    rows = bounded_rows(thresholds.select("label", "threshold"), MAX_LABELS, "thresholds")
    found = {r["label"]: r["threshold"] for r in rows}
    return [float(found.get(l, default)) for l in labels]
