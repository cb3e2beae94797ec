"""Joins in which a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are sent to all tasks at most, and rows from which a key is one of them at least.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """The inner join of left to right, whose keys are unique and not null; `rows` of right counts the rows of left with its key.

    Keys with more than a HOT_KEYS-th of all `total` rows of left are HOT_KEYS
    at most, so they can be sent to every task, where left's rows meet them
    without a shuffle. The rest is joined by a shuffle, in which no key has
    more rows than that.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = right.where(F.col(rows) > least)
    warm = left.join(F.broadcast(hot), keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(rows) <= least), keys)
    return warm.unionByName(cold)
