"""Reproducible train / validation / test splits."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.columns import hash_bucket
from labelloom.functions.sizing import small_side

CELLS = 4096


def split_name(prompt: Column, seed: int = 42, test: float = 0.2, validation: float = 0.1) -> Column:
    """'test', 'val' or 'train' from a hash of the text: narrow, and equal texts never straddle parts."""
    bucket = hash_bucket(F.concat(F.lit(f"{seed}|"), prompt), 1000)
    t = round(test * 1000)
    v = round((test + validation) * 1000)
    return F.when(bucket < t, "test").when(bucket < v, "val").otherwise("train")


def with_split(df: DataFrame, seed: int = 42, test: float = 0.2, validation: float = 0.1) -> DataFrame:
    return df.withColumn("split", split_name(F.col("prompt"), seed, test, validation))


def exact_split(
    df: DataFrame,
    seed: int = 42,
    test: float = 0.2,
    validation: float = 0.1,
    stratum: str | None = None,
    key: str = "prompt",
) -> DataFrame:
    """Split with exact sizes: ceil(n * test) test rows, then ceil of the validation share of the rest.

    Rows are ranked by hash without a global sort: a histogram over the leading hash digits tells
    which cells lie wholly inside one part; the few cells that a cut runs through get a histogram over
    the next digits, and only the cells of that which are cut again, a sixteen-millionth of the rows
    each, are ranked. With ``stratum`` the sizes hold inside every stratum. ``key`` must be unique.
    """
    group = [stratum] if stratum else []
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    hashed = df.withColumn("_h", digest).withColumns(
        {c: F.conv(F.substring("_h", at, 3), 16, 10).cast("int") for c, at in (("_cell", 1), ("_sub", 4))}
    )
    cells = hashed.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # At most CELLS rows per stratum meet in one window.
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.coalesce(
        F.sum("_n").over(whole.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    size = F.sum("_n").over(whole)
    share = validation / (1.0 - test)
    n_test = F.ceil(F.round(size * F.lit(test), 6))
    n_val = F.ceil(F.round((size - n_test) * F.lit(share), 6))
    cells = cells.withColumn("_before", before).withColumn("_t", n_test).withColumn("_v", n_test + n_val)

    def crossed(first: Column, last: Column) -> Column:
        return ((first < F.col("_t")) & (last > F.col("_t"))) | ((first < F.col("_v")) & (last > F.col("_v")))

    cells = cells.withColumn("_cut", crossed(F.col("_before"), F.col("_before") + F.col("_n"))).drop("_n")

    def part(rank: Column) -> Column:
        return F.when(rank < F.col("_t"), "test").when(rank < F.col("_v"), "val").otherwise("train")

    # Without strata the histogram has at most CELLS rows; with strata their number decides.
    side = F.broadcast(cells) if stratum is None else small_side(cells, 64 * CELLS)
    joined = hashed.join(side, [*group, "_cell"])
    sure = joined.filter(~F.col("_cut")).withColumn("split", part(F.col("_before")))
    edge = joined.filter("_cut").drop("_cut", "_before")
    place = [*group, "_cell"]
    below = F.sum("_n").over(W.partitionBy(*place).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1))
    subs = edge.groupBy(*place, "_sub", "_t", "_v").agg(F.count(F.lit(1)).alias("_n"))
    subs = subs.join(cells.filter("_cut").select(*place, "_before"), place)
    subs = subs.withColumn("_from", F.col("_before") + F.coalesce(below, F.lit(0)))
    subs = subs.withColumn("_cut", crossed(F.col("_from"), F.col("_from") + F.col("_n"))).select(*place, "_sub", "_from", "_cut")
    # Each cut runs through one cell, so there are two cells of at most CELLS sub-cells per stratum.
    near = edge.join(F.broadcast(subs) if stratum is None else subs, [*place, "_sub"])
    inside = near.filter(~F.col("_cut")).withColumn("split", part(F.col("_from")))
    inner = F.row_number().over(W.partitionBy(*place, "_sub").orderBy("_h", key))
    ranked = near.filter("_cut").withColumn("split", part(F.col("_from") + inner - 1))
    return sure.select(*df.columns, "split").unionByName(inside.select(*df.columns, "split")).unionByName(
        ranked.select(*df.columns, "split"))


def split_sizes(n: int, test: float = 0.2, validation: float = 0.1) -> tuple[int, int, int]:
    """(train, validation, test) sizes of exact_split for n rows."""
    n_test = ceil(round(n * test, 6))
    n_val = ceil(round((n - n_test) * validation / (1.0 - test), 6))
    return n - n_test - n_val, n_val, n_test
