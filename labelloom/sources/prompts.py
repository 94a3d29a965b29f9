"""Labelled prompt sources and the writers that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.labels import membership, to_long
from labelloom.operators import adapters
from labelloom.sources import stitched

RECORD_SCHEMA = "prompt string, relevant_tools array<string>"


def read_prompt_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Prompt records from JSON: one object per line, or (``multiline``) lists of objects laid out in any
    way. Both are read by several tasks per file."""
    if multiline:
        return complete_records(stitched.read_json_list(spark, path, RECORD_SCHEMA))
    return complete_records(spark.read.schema(RECORD_SCHEMA).json(path))


def complete_records(df: DataFrame) -> DataFrame:
    """Missing prompt gives '', missing list gives []."""
    return df.select(
        F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.coalesce("relevant_tools", F.array().cast("array<string>")).alias("relevant_tools"),
    )


def read_table(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = False) -> DataFrame:
    """Labelled table as stored. CSV columns stay text; ``multiline`` is for files whose quoted cells
    hold line breaks. Both are read by several tasks per file."""
    if fmt == "csv":
        return stitched.read_csv(spark, path) if multiline else spark.read.csv(path, header=True, escape='"')
    return spark.read.format(fmt).load(path)


def load_labelled(
    spark: SparkSession, path: str, labels: Sequence[str], fmt: str = "csv", multiline: bool = False
) -> DataFrame:
    """Read, detect the layout, convert and validate: (prompt, y)."""
    return adapters.to_canonical(read_table(spark, path, fmt, multiline), labels)


def load_sources(
    spark: SparkSession, source: str, paths: dict[str, str], labels: Sequence[str], fmt: str = "csv",
    multiline: bool = False,
) -> DataFrame:
    """Labelled rows of one named source, or of all of them for 'combined'."""
    if source == "combined":
        names = sorted(paths)
    elif source in paths:
        names = [source]
    else:
        raise ValueError(f"unknown source: {source}")
    out = load_labelled(spark, paths[names[0]], labels, fmt, multiline)
    for name in names[1:]:
        out = out.unionByName(load_labelled(spark, paths[name], labels, fmt, multiline))
    return out


def records_to_vectors(records: DataFrame, labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., prompt, y) of prompt records; blank prompts dropped, prompts trimmed."""
    return records.filter(~tx.is_blank(F.col("prompt"))).select(
        *keep, tx.strip(F.col("prompt")).alias("prompt"), membership(F.col("relevant_tools"), labels).alias("y")
    )


def long_table(records: DataFrame, labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., prompt, tool, label): every record against every catalog label."""
    vectors = records_to_vectors(records, labels, keep)
    return to_long(vectors, labels, [*keep, "prompt"]).select(
        *keep, "prompt", F.col("label").alias("tool"), F.col("y").alias("label")
    )


def write_long_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Training pairs, one partition folder per tool so a per-tool read skips the rest.

    Rows are rebalanced by tool first: few files for a small tool, several for a large one.
    """
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.hint("rebalance", "tool").write.mode("overwrite").partitionBy("tool").format(fmt).save(path)
