"""Joins whose hot keys do not land in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds over one in so many rows; there are fewer hot keys than that, whatever the input.
SHARE = 1000


def hot_keys(counts: DataFrame, keys: list[str], rows: int, share: int = SHARE) -> DataFrame | None:
    """The hot keys as a small local table, or None without any. counts: (keys, count); nulls, which match nothing, are none."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    hot = counts.filter(known & (F.col("count") * share > rows) & (F.col("count") > 1)).select(*keys)
    found = hot.collect()  # fewer than `share` rows: their counts add up to `rows` at most
    return counts.sparkSession.createDataFrame(found, hot.schema) if found else None


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = SHARE, counts: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """left joined (inner or left) with right, whose keys are unique.

    The hot keys of left, each in over one of `share` rows, meet their rows of right by broadcast (fewer than `share`
    rows), the others by shuffle: no task gets more than a share-th of left for one key. left is read once more to count
    its keys; counts (keys, count) and its number of rows may be given instead. Columns: the keys, then the rest of both.
    """
    counts = left.groupBy(*keys).count() if counts is None else counts
    hot = hot_keys(counts, keys, left.count() if rows is None else rows, share)
    if hot is None:
        return left.join(right, keys, how)
    few = right.join(F.broadcast(hot), keys, "left_semi")
    own, rest = left.join(F.broadcast(hot), keys, "left_semi"), left.join(F.broadcast(hot), keys, "left_anti")
    return own.join(F.broadcast(few), keys, how).unionByName(rest.join(right, keys, how))
