"""Checked sizes: what may reach the driver or a broadcast, and how small inputs are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

MAX_LABELS = 20_000
SPREAD_BELOW_BYTES = 256 * 1024 * 1024


class TooLarge(ValueError):
    """A table meant to be a small dimension is larger than its bound."""


def bounded_rows(df: DataFrame, bound: int, what: str) -> list[Row]:
    """Rows of a small table; never more than ``bound`` + 1 leave the executors."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise TooLarge(f"{what}: more than {bound} rows")
    return rows


def small_side(df: DataFrame, bound: int = MAX_LABELS) -> DataFrame:
    """A dimension as a broadcast join side if it really has at most ``bound`` rows.

    A longer table is returned as it is and Spark chooses the join from its own statistics.
    """
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal a small scan out to all cores.

    A small file is often one row group and so one task. Large inputs come in many row groups and
    are left as they are: the text is never shuffled just for balance.
    """
    if estimated_bytes(df) < SPREAD_BELOW_BYTES:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df
