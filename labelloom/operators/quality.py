"""Data quality: cleaning, issue report and dataset description."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.columns import ratio, str_array

WORD = 62  # labels in a word of bits
ROW = -1  # position of the per-prompt counters among the per-label ones


def _merged(df: DataFrame, n_labels: int, *keys: str) -> DataFrame:
    """One row per distinct key with its number of copies and the element-wise maximum of y."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), *[F.max(F.get("y", F.lit(i))).alias(f"_y{i}") for i in range(n_labels)]
    ).select(*keys, "copies", F.array(*[F.col(f"_y{i}") for i in range(n_labels)]).alias("y"))


def clean(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Blank prompts removed, equal texts merged with OR, labels clipped to 0/1.

    Texts meet by digest, with their labels as bits of a few words: one word and one ``bit_or`` for
    ``WORD`` labels. Copies collapse before the shuffle, which carries a text once per task.
    """
    starts = range(0, len(labels), WORD)
    packed = [F.aggregate(F.slice("y", at + 1, WORD), F.lit(0).cast("long"),
                          lambda a, v: F.call_function("shiftleft", a, F.lit(1)) + (v >= 1).cast("long")).alias(f"_w{at}")
              for at in starts]
    keyed = df.filter(~tx.is_blank(F.col("prompt"))).select(tx.digest(F.col("prompt")).alias("_d"), "prompt", *packed)
    merged = keyed.groupBy("_d").agg(F.first("prompt").alias("prompt"), *[F.bit_or(f"_w{at}").alias(f"_w{at}") for at in starts])

    def bits(at: int) -> Column:
        n = min(WORD, len(labels) - at)
        places = F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1))
        return F.transform(places, lambda i: F.call_function("shiftright", F.col(f"_w{at}"), i).bitwiseAND(F.lit(1)).cast("int"))

    return merged.select("prompt", F.concat(F.array().cast("array<int>"), *[bits(at) for at in starts]).alias("y"))


def quality_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every counter behind the report in one pass: position -1 for prompts, then one row per label.

    Texts are grouped by digest, so the shuffle carries 32 bytes per distinct text; the fan-out to
    labels is folded back by the map-side aggregation.
    """
    keyed = df.select(tx.digest(F.col("prompt")).alias("_d"), tx.is_blank(F.col("prompt")).alias("blank"), "y")
    merged = _merged(keyed, len(labels), "_d", "blank")
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v)
    per_label = F.transform(
        F.col("y"), lambda v, i: F.struct(i.alias("pos"), v.cast("double").alias("v"))
    )
    row = F.array(F.struct(F.lit(ROW).alias("pos"), total.alias("v")))
    cells = merged.select("copies", "blank", F.explode(F.concat(row, per_label)).alias("c")).select(
        "copies", "blank", "c.pos", "c.v"
    )
    kept = ~F.col("blank")
    return cells.groupBy("pos").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank_rows"),
        F.count_if(kept).alias("prompts"),
        F.count_if(kept & (F.col("v") == 0)).alias("zero"),
        F.count_if(kept & (F.col("v") == 1)).alias("one"),
        F.count_if(kept & ~F.col("v").isin(0.0, 1.0)).alias("invalid"),
    )


def quality_report(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(check_no, pos, label, n, message), one row per issue found."""
    name = F.get(str_array(labels), F.col("pos"))
    is_row = F.col("pos") == ROW
    duplicates = F.col("rows") - F.col("blank_rows") - F.col("prompts")
    removed = F.col("rows") - F.col("prompts")

    def issue(no: int, applies: Column, n: Column, *message) -> Column:
        parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
        return F.when(
            applies,
            F.struct(F.lit(no).alias("check_no"), n.cast("long").alias("n"), F.concat(*parts).alias("message")),
        )

    def n(column: Column) -> Column:
        return column.cast("string")

    # The wording of the messages.
    tool = ("Tool '", F.col("label"), "' ")
    issues = F.array(
        issue(1, is_row & (F.col("blank_rows") > 0), F.col("blank_rows"),
              "Found ", n(F.col("blank_rows")), " empty prompts — removed"),
        issue(2, is_row & (duplicates > 0), duplicates,
              "Found ", n(duplicates), " duplicate prompts — merged with OR logic"),
        issue(3, is_row & (F.col("zero") > 0), F.col("zero"),
              "Found ", n(F.col("zero")), " prompts with no tool selected — kept (valid negative examples)"),
        issue(4, ~is_row & (F.col("one") == 0), F.col("one"),
              *tool, "has ZERO positive examples — model cannot learn it"),
        issue(4, ~is_row & F.col("one").between(1, 2), F.col("one"),
              *tool, "has only ", n(F.col("one")), " positive examples — may underperform"),
        issue(5, ~is_row & (F.col("zero") == 0), F.col("zero"),
              *tool, "has ZERO negative examples — model cannot learn it"),
        issue(6, ~is_row & (F.col("invalid") > 0), F.col("invalid"),
              *tool, "has ", n(F.col("invalid")), " invalid labels — clipped to 0/1"),
        issue(7, is_row & (removed > 0), removed, "Total rows removed: ", n(removed)),
    )
    return (
        quality_counts(df, labels)
        .withColumn("label", F.when(~is_row, name))
        .select("pos", "label", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("i"))
        .select("i.check_no", "pos", "label", "i.n", "i.message")
    )


def describe_dataset(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: shape, distinct and duplicate prompts, nulls, labels per prompt."""
    held = F.aggregate("y", F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)).cast("long"))
    nulls = F.size(F.filter("y", lambda v: v.isNull())) + F.col("prompt").isNull().cast("int")
    rows = df.select(tx.digest(F.col("prompt")).alias("prompt"), held.alias("held"), nulls.alias("nulls"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("prompt").alias("unique_prompts"),
        F.coalesce(F.sum("nulls"), F.lit(0)).cast("long").alias("missing_values"),
        F.avg("held").alias("avg_labels"),
        F.max("held").alias("max_labels"),
        F.count_if(F.col("held") > 1).alias("multi_label_prompts"),
        (F.max(F.col("prompt").isNull().cast("int"))).alias("_null_prompt"),
    ).select(
        "n_rows",
        F.lit(len(labels) + 1).cast("long").alias("n_columns"),
        "unique_prompts",
        (F.col("n_rows") - F.col("unique_prompts") - F.coalesce("_null_prompt", F.lit(0))).alias("duplicate_prompts"),
        "missing_values", "avg_labels", "max_labels", "multi_label_prompts",
    )


def label_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Positives, negatives and percentage of positives per label."""
    counted = df.select(F.posexplode("y").alias("pos", "v")).groupBy("pos").agg(
        F.count_if(F.col("v") == 1).alias("positives"),
        F.count_if(F.col("v") == 0).alias("negatives"),
        F.count(F.lit(1)).alias("rows"),
    )
    return counted.select(
        "pos",
        F.get(str_array(labels), F.col("pos")).alias("label"),
        "positives",
        "negatives",
        ratio(F.col("positives") * 100.0, F.col("rows")).alias("pct_positive"),
    )


def labels_per_row(y: str = "y") -> Column:
    """Row sum of a label vector."""
    return F.aggregate(F.col(y), F.lit(0), lambda a, v: a + v.cast("int"))


def count_listed(records: DataFrame, column: str = "relevant_tools") -> DataFrame:
    """How often each label occurs in the lists of prompt records."""
    return records.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
