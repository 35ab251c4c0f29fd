"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys counted as hot hold at least one in HOT_SHARE of all rows: there can be no more of them.
HOT_SHARE = 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner", floor: int = 20_000) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and, in ``count``, the key's
    number of rows on the left.  The rows of hot keys stay where they are and meet a broadcast of at
    most HOT_SHARE rows; the others are shuffled as usual."""
    limit = max(total // HOT_SHARE, floor)
    if total < limit:
        return left.join(right, key, how)
    hot = F.broadcast(right.filter(F.col(count) >= limit))
    cold = right.filter(F.col(count) < limit)
    keys = hot.select(key)
    if how == "inner":
        return left.join(hot, key).unionByName(left.join(F.broadcast(keys), key, "left_anti").join(cold, key))
    if how == "left":
        return left.join(hot, key).unionByName(left.join(F.broadcast(keys), key, "left_anti").join(cold, key, "left"))
    raise ValueError(how)


def lookup(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner", floor: int = 20_000) -> DataFrame:
    """:func:`join_hot` for a ``right`` side (one row a key) that doesn't know how often its keys occur
    on the left: they are counted first, pre-aggregated, unless ``left`` is small."""
    if total < max(total // HOT_SHARE, floor):
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    return join_hot(left, right.join(counts, key), key, "_n", total, how, floor).drop("_n")
