"""Packing lengths into sequences: decreasing variants over the length histogram of all rows, first fit within shards."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import ship
from ..storage import written


def no_pack(ids: Column, length: int, eos: int | None = None, pad: int = 0) -> Column:
    """struct<ids, mask, positions>: the end token appended, then cut or padded to a length."""
    own = F.concat(ids, F.array(F.lit(eos).cast("int"))) if eos is not None else ids
    n = F.least(F.size(own), F.lit(length))
    return F.struct(
        F.slice(F.concat(own, F.array_repeat(F.lit(pad).cast("int"), length)), 1, length).alias("ids"),
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < n, 1).otherwise(0)).alias("mask"),
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < n, i).otherwise(0)).alias("positions"),
    )


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which of them have open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size).bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, has: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = has
        while i := i >> 1:
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open bin."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """Best-fit decreasing over a length histogram. Per length an array of (first piece, first bin, pieces a bin, offset).

    Pieces of one length are numbered from 0; those of an entry fill its bins one after another. Also the number of bins.
    """
    tree, runs, bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], 0
    plan: dict[int, np.ndarray] = {}

    def opened(left: int, first: int, n: int) -> None:
        if n and left:
            runs[left].append((first, n))
            tree.set(left, True)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        todo, done, steps = histogram[length], 0, []

        def deal(first: int, n: int, left: int, length: int = length, steps: list = steps) -> int:
            """Deal pieces to n equal bins from `first`; the bins that got some."""
            nonlocal todo, done
            each = left // length
            full, rest = divmod(min(todo, n * each), each)
            for at, k, m in ((first, each, full), (first + full, rest, 1 if rest else 0)):
                if m:
                    steps.append((done, at, k, capacity - left))
                    opened(left - k * length, at, m)
                    done, todo = done + k * m, todo - k * m
            return full + bool(rest)

        while todo:
            left = tree.tightest(length)
            if left is None:
                bins += deal(bins, -(-todo // (capacity // length)), capacity)
                continue
            first, n = runs[left].popleft()
            if not runs[left]:
                tree.set(left, False)
            used = deal(first, n, left)
            opened(left, first + used, n - used)
        plan[length] = np.array(steps, np.int64)
    return plan, bins


def placed(plan: dict[int, np.ndarray], length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of the pieces of one length with these ranks."""
    steps = plan[length]
    own = steps[np.searchsorted(steps[:, 0], ranks, "right") - 1]
    nth = ranks - own[:, 0]
    return own[:, 1] + nth // own[:, 2], own[:, 3] + nth % own[:, 2] * length


def first_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """First-fit decreasing over a length histogram, in the form of `best_fit_plan`.

    Bins in their order are runs of equal remaining capacity; a run of equal pieces is dealt to a run of bins in one step.
    """
    first, size, room = (np.zeros(0, np.int64) for _ in range(3))
    plan: dict[int, np.ndarray] = {}
    bins = 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        todo, done, steps, at = histogram[length], 0, [], 0
        while todo:
            fits = np.flatnonzero(room[at:] >= length)
            if not len(fits):
                each = capacity // length
                new = -(-todo // each)
                first, size, room = np.append(first, bins), np.append(size, new), np.append(room, capacity)
                bins += new
                continue
            k = at + int(fits[0])
            left, begin, n = int(room[k]), int(first[k]), int(size[k])
            each = left // length
            full, rest = divmod(min(todo, n * each), each)
            runs = [(begin, full, each), (begin + full, 1 if rest else 0, rest), (begin + full + bool(rest), n - full - bool(rest), 0)]
            for start, m, pieces in runs[:2]:
                if m:
                    steps.append((done, start, pieces, capacity - left))
                    done, todo = done + m * pieces, todo - m * pieces
            runs = [(start, m, left - pieces * length) for start, m, pieces in runs if m]
            first, size, room = (np.concatenate((x[:k], np.array([r[i] for r in runs], np.int64), x[k + 1 :])) for i, x in enumerate((first, size, room)))
            at = k + 1
        plan[length] = np.array(steps, np.int64)
    return plan, bins


def _packed(lengths: list[int], capacity: int) -> list[int]:
    """The first bin with room for each length, in the given order."""
    room: list[int] = []
    out = []
    for n in lengths:
        i = next((i for i, r in enumerate(room) if r >= n), len(room))
        if i == len(room):
            room.append(capacity)
        room[i] -= n
        out.append(i)
    return out


def pack(df: DataFrame, key: str, length: str, capacity: int, strategy: str = "greedy", shard_rows: int = 2000) -> DataFrame:
    """(key, length, shard, bin): strategy first_fit (by key), best_fit or greedy (longest first; tightest or first bin).

    Lengths over the capacity count as the capacity. Longest first, only the number of rows of each length matters, at most
    `capacity` numbers: all rows are packed at once on them (shard 0), and each row looks its bin up by its rank among the
    rows of its length. First fit depends on the order of all rows: they are dealt into shards of about shard_rows by a
    hash of the key, each packed on its own.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.least(F.col(length).cast("long"), F.lit(capacity)).alias("length"))
    if strategy == "first_fit":
        shards = max(1, -(-df.count() // shard_rows))

        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("key")
            return group.assign(bin=_packed(group["length"].tolist(), capacity))

        dealt = rows.withColumn("shard", F.pmod(hash_key("pack", F.col("key")), F.lit(shards)).cast("int"))
        return dealt.groupBy("shard").applyInPandas(one, "key long, length long, shard int, bin long").withColumnRenamed("key", key)
    held = written(rows.withColumn("part", F.spark_partition_id()))
    counts = held.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = (best_fit_plan if strategy == "best_fit" else first_fit_plan)(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("key")) - 1
    ranked = held.withColumn("nth", nth).join(before, ["part", "length"]).select("key", "length", (F.col("before") + F.col("nth")).cast("long").alias("rank"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            where, order = np.zeros(len(rank), np.int64), np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                where[own], _ = placed(shared.value, int(size[own[0]]), rank[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(rank), np.int32)), pa.array(where)], ["key", "length", "shard", "bin"])

    return ranked.mapInArrow(place, "key long, length long, shard int, bin long").withColumnRenamed("key", key)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """rows, bins, tokens, efficiency, padding, rows a bin."""
    bins = packed.groupBy("shard", "bin").agg(F.count("*").alias("n"), F.sum("length").alias("t"))
    return bins.agg(F.sum("n").alias("rows"), F.count("*").alias("bins"), F.sum("t").alias("tokens")).select("*", (F.col("tokens") / (F.col("bins") * capacity)).alias("efficiency"), (F.col("bins") * capacity - F.col("tokens")).alias("padding"), (F.col("rows") / F.col("bins")).alias("rows_per_bin"))


def lttb(df: DataFrame, series: str, step: str, value: str, threshold: int) -> DataFrame:
    """Largest-triangle down-sampling of each series to at most `threshold` points; its ends stay."""

    def pick(n: int, x: list[float], y: list[float]) -> Iterator[int]:
        if threshold < 3 or n <= threshold:
            yield from range(n)
            return
        yield 0
        size, last = (n - 2) / (threshold - 2), 0
        for i in range(threshold - 2):
            lo, hi = int(i * size) + 1, min(int((i + 1) * size) + 1, n - 1)
            mx, my = sum(x[lo:hi]) / max(hi - lo, 1), sum(y[lo:hi]) / max(hi - lo, 1)
            last = max(range(lo, hi), key=lambda j: abs((x[last] - mx) * (y[j] - y[last]) - (x[last] - x[j]) * (my - y[last])), default=last)
            yield last
        yield n - 1

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        return group.iloc[list(pick(len(group), group["step"].astype(float).tolist(), group["value"].tolist()))]

    rows = df.select(F.col(series).cast("string").alias("series"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("series").applyInPandas(one, "series string, step long, value double")
