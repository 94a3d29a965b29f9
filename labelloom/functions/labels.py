"""Label vectors: ``y ARRAY<INT>`` aligned with the catalog order.

One row per prompt carries all its labels, so adapters, scoring, selection and routing stay narrow;
rows are only fanned out to (prompt, label) right before an aggregation whose partial step folds
them back to one row per label and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.columns import let, str_array

_BITS = 62  # label flags carried per BIGINT


def coerce(value: Column) -> Column:
    """Numeric or textual label to 0/1: non-numbers are 0, fractions truncate, the rest is clipped."""
    number = value.try_cast("double")
    number = F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).cast("int")


def membership(names: Column, labels: Sequence[str]) -> Column:
    """y vector of a set of label names."""
    return let(
        names,
        lambda held: F.transform(
            str_array(labels), lambda l: F.coalesce(F.array_contains(held, l), F.lit(False)).cast("int")
        ),
    )


def names_of(y: Column, labels: Sequence[str]) -> Column:
    """Names of the positive labels, in catalog order."""
    pairs = F.arrays_zip(y.alias("y"), str_array(labels).alias("label"))
    return F.transform(F.filter(pairs, lambda p: p["y"] == 1), lambda p: p["label"])


def merge_flags(pos: Column, flag: Column, n_labels: int) -> list[Column]:
    """Fixed-width aggregates that OR 0/1 flags of rows carrying one label position each.

    BIT_OR buffers are plain longs: the aggregation stays a generated hash aggregation with a
    map-side step, whatever the number of rows behind one prompt.
    """
    out = []
    for k in range((n_labels + _BITS - 1) // _BITS):
        inside = (flag == 1) & (F.floor(pos / F.lit(_BITS)) == k)
        bit = F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), (pos % F.lit(_BITS)).cast("int")))
        out.append(F.bit_or(F.coalesce(bit, F.lit(0).cast("long"))).alias(f"_m{k}"))
    return out


def flags_to_vector(n_labels: int) -> Column:
    """y vector from the aggregates of merge_flags."""
    one = F.lit(1).cast("long")

    def bits(word: Column, width: int) -> Column:
        slots = F.sequence(F.lit(0), F.lit(width - 1))
        return let(
            word,
            lambda m: F.transform(slots, lambda j: F.call_function("shiftright", m, j).bitwiseAND(one).cast("int")),
        )

    words = []
    for k in range((n_labels + _BITS - 1) // _BITS):
        words.append(bits(F.col(f"_m{k}"), min(_BITS, n_labels - k * _BITS)))
    return F.concat(*words)


def to_long(df: DataFrame, labels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, pos, label, y): one row per prompt and label."""
    pairs = F.arrays_zip(str_array(labels).alias("label"), F.col("y").alias("y"))
    return df.select(*keys, F.posexplode(pairs).alias("pos", "_p")).select(
        *keys, "pos", F.col("_p.label").alias("label"), F.col("_p.y").alias("y")
    )


def to_wide(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("prompt",)) -> DataFrame:
    """One 0/1 column per label, in catalog order."""
    return df.select(*keys, *[F.get("y", F.lit(i)).alias(l) for i, l in enumerate(labels)])


def to_positive(df: DataFrame, labels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sparse view: only the (prompt, label) pairs that hold."""
    return df.select(*keys, F.explode(names_of(F.col("y"), labels)).alias("label"))
