"""Operator 4: nearest neighbours by inner product through a permutation index.

Pivots are common to all vectors, fitted on a bounded sample. Every vector is represented by the order of its nearest
pivots and posted in the inverted file of each of these with the pivot's rank. Vectors are dealt into segments of bounded
size, each with its own inverted files; a query carries its order, and the postings of its pivots give the footrule
distance to every vector that shares one. The nearest share of a segment is reranked by the exact inner product. Queries
stream past each segment in blocks.

Inner product is turned into an angle first: a vector is scaled by the largest norm and gets one more coordinate that
brings it to length one; queries get zero there. Equal vectors are indexed once and answered by their smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

#: Vectors of a segment, about.
SEGMENT = 8192
#: Pivots at most, a bounded sample of the vectors; a vector that is posted with one in SPREAD of them, LEAST_NEAR at least.
PIVOTS, SPREAD, LEAST_NEAR = 1024, 24, 16
#: The share of a segment's distinct vectors that is reranked, and how many for each neighbour asked for at least.
RERANK, EACH = 0.2, 10


class Pivots:
    """The pivots of vectors of one length. norm: the largest norm of the vectors that are scaled by it."""

    def __init__(self, vectors: np.ndarray, norm: float, pivots: int = PIVOTS):
        self.norm = norm
        self.table = self.flat(np.unique(vectors + 0.0, axis=0)[:pivots])
        self.near = min(len(self.table), max(LEAST_NEAR, math.ceil(len(self.table) / SPREAD)))

    def flat(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of the table on the unit sphere of one more dimension."""
        scaled = vectors / self.norm
        return np.column_stack((scaled, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled))))).astype(np.float32)

    def order(self, flat: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        out = np.empty((len(flat), self.near), np.int64)
        for i in range(0, len(flat), 2048):
            s = -(flat[i : i + 2048] @ self.table.T)
            part = np.argpartition(s, self.near - 1, axis=1)[:, : self.near]
            out[i : i + 2048] = np.take_along_axis(part, np.argsort(np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
        return out


class Segment:
    """The index of one segment. ids, vectors: its rows; k: neighbours that a query asks for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: Pivots, k: int, share: float = RERANK):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)  # no negative zeros
        _, first, copy = np.unique(vectors.view(np.void(vectors.dtype.itemsize * vectors.shape[1]).dtype).reshape(-1), return_index=True, return_inverse=True)
        self.vectors, self.k, self.pivots = vectors[first], k, pivots
        self.rough = self.vectors.astype(np.float32) / np.float32(pivots.norm)
        by = np.argsort(copy, kind="stable")  # equal vectors together, smaller ids first
        cuts = np.searchsorted(copy[by], np.arange(len(first) + 1))
        self.members = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # the query itself and k others at most
        n, near = len(self.vectors), pivots.near
        self.rerank = min(n, max(EACH * (k + 1), math.ceil(share * n)))
        own = pivots.order(pivots.flat(self.vectors))
        by = np.argsort(own, axis=None, kind="stable")
        self.cuts = np.searchsorted(own.reshape(-1)[by], np.arange(len(pivots.table) + 1))
        self.who, self.ranks = by // near, (by % near).astype(np.int32)

    def candidates(self, order: np.ndarray) -> np.ndarray:
        """The vectors nearest in footrule distance. Ranks beyond the posted ones count as `near`, so that a shared pivot
        of ranks r and s lowers the distance by 2 (near - max(r, s)) from that of two orders that share none."""
        lo, width = self.cuts[order], self.cuts[order + 1] - self.cuts[order]
        at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        gain = self.pivots.near - np.maximum(self.ranks[at], np.repeat(np.arange(len(order), dtype=np.int32), width))
        nearness = np.bincount(self.who[at], gain, minlength=len(self.vectors))
        return np.argpartition(-nearness, self.rerank - 1)[: self.rerank]

    def search(self, ids: np.ndarray, orders: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the nearest k found for each query."""
        norms = np.linalg.norm(queries, axis=1)
        for own, order, query, norm in zip(ids.tolist(), orders, queries, norms, strict=True):
            near = self.candidates(order)
            rough = self.rough[near] @ (query / norm).astype(np.float32)
            if len(near) > self.k + 1:
                bar = np.partition(rough, len(rough) - self.k - 1)[len(rough) - self.k - 1]
                near = near[rough >= bar - 1e-5]  # beyond what single precision can confuse
            scores = inner(self.vectors[near], query)
            rows = [(-s, m) for s, at in zip(scores.tolist(), near.tolist(), strict=True) for m in self.members[at].tolist() if m != own]
            rows.sort()
            rows = rows[: self.k]
            yield own, np.array([m for _, m in rows], np.int64), -np.array([s for s, _ in rows], np.float64)


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        out += vectors[:, j] * query[j]
    return out


def fit(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, Pivots]:
    """Pivots by length of vectors (dim, id, v): for each length the `pivots` vectors first in the order of a hash of their ids.

    The sample is bounded by the parameter; lengths are few. Only the pivots and the norms come to the driver.
    """
    norms = {r["dim"]: r["norm"] for r in vectors.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).collect()}
    out = {}
    for dim, norm in norms.items():
        rows = vectors.filter(F.col("dim") == dim).select("v", F.xxhash64("id", F.lit("pivot")).alias("h"), "id").orderBy("h", "id").limit(pivots).collect()
        out[dim] = Pivots(np.array([r["v"] for r in rows]), norm, pivots)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, segment: int = SEGMENT, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, share: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, ties to the smaller id.

    queries: rows like those of vectors; candidates: every row but those with the query's id. Vectors that are null,
    zero, or hold null or non-finite components take no part; vectors of different lengths never meet. A query without
    candidates has no row; rows that repeat an id are candidates of their own, and a repeated query is one query. Other
    columns, whatever their names, are not looked at. Empty tables: no row.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
        return rows.select(F.size("v").alias("dim"), "id", "v")

    own, asked = clean(vectors), clean(queries).dropDuplicates(["id"])
    parts = max(1, math.ceil(vectors.count() / segment))
    shared = own.sparkSession.sparkContext.broadcast(fit(own, pivots))

    def ordered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in _runs(batch, 1):
                dim, rows = part.column(0)[0].as_py(), _matrix(part, 2)
                if dim in shared.value:
                    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
                    order = shared.value[dim].order(np.column_stack((unit, np.zeros(len(unit)))).astype(np.float32))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(order.reshape(-1).astype(np.int32)), order.shape[1]).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], ["dim", "id", "v", "pivots"])

    mine = own.select("dim", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("segment"), F.lit(0).alias("kind"), "id", "v", F.array().cast("array<int>").alias("pivots"))
    sent = arrow_map(asked, ordered, "dim int, id long, v array<double>, pivots array<int>").select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("segment"), F.lit(1).alias("kind"), "id", "v", "pivots")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in it:
            for part in _runs(batch, 3):
                dim, seg, kind = (part.column(i)[0].as_py() for i in range(3))
                if (dim, seg) != key:
                    key, held, index = (dim, seg), [], None
                ids, rows = part.column(3).to_numpy(), _matrix(part, 4)
                if kind == 0:
                    held.append((ids, rows))
                    continue
                if index is None and held:
                    index = Segment(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), shared.value[dim], k, share)
                    held = []
                if index is None:
                    continue
                found = list(index.search(ids, _matrix(part, 5), rows))
                sizes = [len(x) for _, x, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], sizes).astype(np.int64)), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    # each segment is whole in one task, and its vectors come before the queries
    dealt = mine.unionByName(sent).repartition("dim", "segment").sortWithinPartitions("dim", "segment", "kind", "id")
    found = arrow_map(dealt, search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of equal values in its first columns."""
    n = batch.num_rows
    if not n:
        return
    table = np.stack([batch.column(i).to_numpy() for i in range(keys)])
    cuts = [0, *(np.flatnonzero((table[:, 1:] != table[:, :-1]).any(axis=0)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
