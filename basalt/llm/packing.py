"""Operator 7: best-fit decreasing packing of token pieces into sequences of a fixed length.

Best-fit decreasing looks at lengths only, and there are at most `capacity` of them. So the whole corpus is packed at
once on its length histogram, whose size does not depend on the input: open bins of one remaining capacity are kept as
runs of bin numbers, a segment tree over the capacities finds the tightest one in logarithmic time, and a run of equal
pieces is dealt to a run of equal bins in one step (`operators/packing.py`). Every piece then looks up its place by its rank among the pieces of
its length; ranks come from counts by (task, length), so that a length that holds a third of all rows is no hot group.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.packing import best_fit_plan, placed
from .common import arrow_map, written
from .encoding import encoder


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]): nth counts the pieces of a length within a task."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        tail = np.array([] if end_id is None else [end_id], np.int32)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode(part.column(1).to_pylist()), strict=True):
                    ids = np.concatenate((ids, tail)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((key, k, start, len(own), zlib.crc32(own), task, seen[len(own)], *([own.astype(np.int32).tolist()] if with_ids else [])))
                        seen[len(own)] += 1
                columns = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[: 7 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), cut, schema, keep=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    A document is its ids, then end_id; longer ones than `capacity` are cut. Null texts count as empty; a document
    without any id (no end_id, empty text) has no piece; repeated rows are packed once each; an empty table gives no row.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    counts = cut.groupBy("task", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    before = counts.select("task", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                where[own], offset[own] = placed(shared.value, int(length[own[0]]), rank[own])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(where), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = cut.join(before, ["task", "length"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return arrow_map(ranked, place, schema)
