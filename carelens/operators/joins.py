"""The null-safe anti-join (J6), and a filter by a few keys that reaches the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_anti_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``, NULL matching NULL.

    dplyr's anti_join treats NA as equal to NA; a plain anti-join would keep
    a NULL-keyed row. The planner picks the strategy from measured sizes.
    """
    r = right.select(F.col(key).alias("_rk")).distinct()
    return left.join(r, left[key].eqNullSafe(r["_rk"]), "left_anti")


def scan_filter(key: str, keys: DataFrame, points: int = 4) -> Column:
    """A condition on ``key`` that holds for every key in ``keys``; an inner join on the key follows it.

    An inner join's keys do not reach a Parquet scan, single values do: the
    first ``points`` keys in order (the last one repeated if there are fewer)
    are compared for equality, and all others lie between the last of those
    and the greatest key. So however many keys there are, none is lost, and
    for a few of them the scan's row groups and pages are chosen by their
    minima and maxima. Every value is a subquery of its own kind (a top-k, not
    an aggregate): aggregates over one table would be merged into one struct,
    whose fields are not pushed down. Without a key nothing passes.
    """
    ids = keys.select(key).filter(F.col(key).isNotNull())

    def nth(n: int) -> Column:
        return ids.orderBy(key).limit(n).orderBy(F.desc(key)).limit(1).scalar()

    named = reduce(Column.__or__, [F.col(key) == nth(n) for n in range(1, points + 1)])
    return named | ((F.col(key) > nth(points)) & (F.col(key) <= ids.orderBy(F.desc(key)).limit(1).scalar()))
