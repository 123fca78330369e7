"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Unset: this machine's temporary folder in local mode, an
    error on a cluster, where each machine would see its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/basalt-shared"


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the shared root, deleted when the driver ends if not before."""
    path = f"{shared_root(spark)}/basalt-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """df, written once as Parquet and read back; its shuffle files, which nothing needs any more, are deleted."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df in the shared folder: cuts the lineage and survives lost executors."""
    return stored(df, path or shared_dir(df.sparkSession))


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, seen whole or not at all. FileExistsError if another writer was first."""
    fs, p = _fs(spark, path)
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
