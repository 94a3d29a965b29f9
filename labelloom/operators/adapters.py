"""Layout detection and conversion to the canonical (prompt, y) form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import labels as lb
from labelloom.functions import text as tx
from labelloom.operators.features import key_parts
from labelloom.sources.catalogs import catalog_frame

FEW_PARTS = 4  # inputs of at most so many parts by key are small enough to be folded by prompt where they are read


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def detect_schema(columns: Sequence[str], labels: Sequence[str]) -> str:
    """canonical, paired_rows, json_tools_col or unknown; reads column names only."""
    names = {c.strip().lower() for c in columns}
    # The names of the layouts and of the columns that tell them, in the order of the rules.
    if "prompt" not in names:
        return "unknown"
    if names.issuperset(labels):
        return "canonical"
    if {"tool", "label"} <= names:
        return "paired_rows"
    if names & {"tools", "relevant_tools"}:
        return "json_tools_col"
    return "unknown"


def from_paired_rows(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(prompt, tool, label) rows to one y vector per prompt.

    Unknown tools and null labels are dropped first, so a prompt with nothing else vanishes. The
    catalog is an ordinary small join side. Small inputs take one shuffle on the prompt, whose map-side
    step leaves one row per prompt and task. That step's hash table has all prompts of a task, which a
    single row group of narrow columns can make many millions, so larger inputs are dealt by prompt and
    task of origin first: into parts that grow in number with the input and not in size. A prompt owning
    a large share of the rows is no hot spot either way: no part has more of it than one task has read.
    """
    catalog = catalog_frame(df.sparkSession, labels).withColumnRenamed("label", "tool")
    rows = df.select("prompt", "tool", F.col("label").alias("_label")).filter(
        F.col("_label").isNotNull() & F.col("prompt").isNotNull()
    )
    if len(labels) <= 1000:
        rows = rows.filter(F.col("tool").isin(*labels))  # reaches the scan
    flags = lb.merge_flags(F.col("pos"), lb.coerce(F.col("_label")), len(labels))
    parts = key_parts(df)
    if df.isStreaming or parts <= FEW_PARTS:
        merged = rows.join(catalog, "tool").groupBy("prompt").agg(*flags)
    else:
        dealt = rows.withColumn("_origin", F.spark_partition_id()).join(catalog, "tool").drop("tool")
        folded = dealt.repartition(parts, "prompt", "_origin").groupBy("prompt", "_origin").agg(*flags)
        words = [c for c in folded.columns if c not in ("prompt", "_origin")]
        merged = folded.repartition(parts, "prompt").groupBy("prompt").agg(*[F.bit_or(c).alias(c) for c in words])
    return merged.select("prompt", lb.flags_to_vector(len(labels)).alias("y"))


def from_label_lists(df: DataFrame, labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(prompt, tools | relevant_tools) to (keep.., prompt, y); rows without a known label stay all zero."""
    column = "tools" if "tools" in df.columns else "relevant_tools"
    cell = F.col(column)
    if dict(df.dtypes)[column] == "string":
        cell = tx.parse_label_cell(cell)
    return df.select(*keep, "prompt", lb.membership(cell, labels).alias("y"))


def from_wide(df: DataFrame, labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One column per label to (keep.., prompt, y)."""
    missing = [c for c in ["prompt", *labels] if c not in df.columns]
    # Fixed value: the message is part of the contract.
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df.select(*keep, "prompt", F.array(*[lb.coerce(F.col(f"`{l}`")) for l in labels]).alias("y"))


def drop_blank(df: DataFrame) -> DataFrame:
    return df.filter(~tx.is_blank(F.col("prompt")))


def to_canonical(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Any supported layout to validated (prompt, y)."""
    df = normalize_headers(df)
    layout = detect_schema(df.columns, labels)
    if layout == "paired_rows":
        out = from_paired_rows(df, labels)
    elif layout == "json_tools_col":
        out = from_label_lists(df, labels)
    elif layout == "canonical":
        out = from_wide(df, labels)
    else:
        raise ValueError(f"Unknown schema. Columns: {df.columns}")
    return drop_blank(out)


def known_only(df: DataFrame, catalog: DataFrame, column: str = "label") -> DataFrame:
    """Semi join: rows whose label the catalog knows."""
    return df.join(catalog.select(F.col("label").alias(column)), column, "left_semi")


def unseen_only(new: DataFrame, existing: DataFrame, key: str = "prompt", order: str = "seq") -> DataFrame:
    """New rows whose text does not exist yet; of several equal texts the first by ``order``.

    Equal texts collapse on both sides before the join (map-side too), so copies never meet in one
    task. The existing corpus is reduced to digests: its texts are not shuffled.
    """
    digest = tx.digest(F.col(key)).alias("_d")
    others = [c for c in new.columns if c not in (key, order)]
    first = new.groupBy(key).agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others]
    )
    known = existing.select(digest).filter(F.col("_d").isNotNull()).distinct()
    return first.select("*", digest).join(known, "_d", "left_anti").select(*new.columns)
