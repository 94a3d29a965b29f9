"""Small column helpers shared by the operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An outer expression named inside a lambda is evaluated once per element after projections
    collapse; binding it as a lambda variable keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def str_array(items: Sequence[str]) -> Column:
    """A list of any length as one literal: the text folds to a constant when the plan is made."""
    return F.from_json(F.lit(json.dumps(list(items))), "array<string>")


def double_array(items: Sequence[float]) -> Column:
    """Like ``str_array``; the shortest decimal form of a double gives back the same double."""
    return F.from_json(F.lit(json.dumps([float(x) for x in items])), "array<double>")


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom with a fixed result for an empty denominator (null when ``empty`` is None)."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def hash_bucket(key: Column, buckets: int) -> Column:
    """Stable bucket in [0, buckets) from the first 32 bits of the MD5 of ``key``."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.lit(buckets)
