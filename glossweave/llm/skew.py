"""Equi-joins in which no key of a large share of the rows lands in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot. There are at most as many hot keys, which bounds what is broadcast.
SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined to right (one row a key), how: inner or left, without moving left rows of hot keys.

    right has a column `rows`, the number of left rows of its key (dropped here); total: rows of left, or more. Rows of right whose
    keys are hot, at most SHARE of them, are broadcast; the others are joined as usual. A null key meets nothing."""
    least = max(1, total // SHARE)
    hot, others = right.where(F.col("rows") > least).drop("rows"), right.where(F.col("rows") <= least).drop("rows")
    met = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(others, keys, how)
    return met.unionByName(rest.select(*met.columns))
