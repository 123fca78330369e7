"""Helpers that the operators of this package share: shared storage, Arrow batches, word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..storage import dropped, get_text, names, put_text, shared_dir, stored, written  # noqa: F401  (the operators take them from here)

#: Rows and bytes of one Arrow batch. Whole texts travel in these batches, so the defaults would be too much memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that this package's operators exchange with Python small, and the package importable there.

    The bounds are session settings that Spark reads when a lazy result is run, so they stay set; smaller ones of the
    caller's are left alone.
    """
    ship(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    now = spark.conf.get(size)
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(size, f"{BATCH_BYTES}b")


#: Tables that a worker keeps from task to task of one operator.
KEPT: list[dict] = []


def tidied(keep: bool = False) -> None:
    """Give freed memory back to the system, which C's and Arrow's allocators hold on to; keep: the tables in KEPT stay."""
    if not keep:
        for table in KEPT:
            table.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep: bool = False) -> DataFrame:
    """mapInArrow under bounded batches. A worker is used again by later tasks, so it is tidied before and after each."""
    bound_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidied(keep)
        yield from f(it)
        tidied(keep)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding. bytes.split() and bytes.lower() touch ASCII only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batches(table: pa.Table, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The table in record batches of bounded size."""
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores appended until no column has it, in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
