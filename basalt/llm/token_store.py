"""Operator 6: token ids in ORC files, in ascending document order, and reading them back.

ORC stores the ids in stripes with integer run-length encoding; row indexes and a Bloom filter on the document id let a
reader skip stripes and row groups. Documents are ranged by id before they are encoded, so the ids are never
shuffled: each sorted range is encoded and written by the task that holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import _lists
from .common import arrow_map, shared_dir
from .encoding import encoder

#: ORC writer settings: Bloom filter on the id, a row index entry for every 1000 rows, 64 MB stripes.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20), "orc.encoding.strategy": "SPEED", "compression": "lz4"}


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the key (null: 0), by a binary search that is one balanced tree of conditions."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), 0).otherwise(tree(0, len(bounds)))


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every text (null: empty), append end_id, write (doc_id, n_tokens, ids) to ORC files ascending by id.

    Repeated ids keep one row each; rows with a null id come first. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([] if end_id is None else [end_id], np.int32)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [np.concatenate((x, tail)) for x in encoder(tokenizer).encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in got], pa.int32()), _lists(got)], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the ranges' bounds from the ids alone; repartitionByRange would read the texts to find them
    bounds = sorted({int(x) for x in rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    ranged = rows.repartitionById(n, range_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id")
    arrow_map(ranged, encode, "doc_id long, n_tokens int, ids array<int>", keep=True).write.mode("overwrite").options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored rows (doc_id, n_tokens, ids); a range of ids is pushed down to the row index, a single id to the Bloom filters
    too."""
    df = spark.read.schema("doc_id long, n_tokens int, ids array<int>").orc(path)
    if first is not None and first == last:
        return df.filter(F.col("doc_id") == F.lit(first))
    for bound, keep in ((first, F.col("doc_id") >= F.lit(first)), (last, F.col("doc_id") <= F.lit(last))):
        df = df if bound is None else df.filter(keep)
    return df


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ids stored before each document, in file order.

    Running sums are taken within a file; the files' totals, one row a file, give each file's own start.
    """

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(2)
            flat, off = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64()), batch.column(3), batch.column(4)], ["doc_id", "n_tokens", "ids_crc32", "file", "at"])

    stored = read_tokens(spark, path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    rows = arrow_map(stored, digest, "doc_id long, n_tokens long, ids_crc32 long, file string, at long").withColumn("nth", F.monotonically_increasing_id())
    sizes = read_tokens(spark, path).select("n_tokens", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.sum("n_tokens").cast("long").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "at", "nth").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return summed.join(before, "file").select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def store_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write docs' ids below the shared folder and return `starts` of the files."""
    path = path or shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer, path, end_id, id_col, text_col)
    return starts(docs.sparkSession, path)
