"""Reading tables by format, inspecting and paging them, reading rows by place, checking them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats by file extension, and the first bytes of formats that have some.
EXTENSIONS = {"csv": "csv tsv", "json": "json jsonl ndjson", "parquet": "parquet", "excel": "xls xlsx", "tfrecord": "tfrecord", "image": "png jpg jpeg gif bmp webp tiff svg", "text": "txt md log rst html", "binary": "bin dat"}
MAGIC = {"parquet": b"PAR1", "png": b"\x89PNG", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8"}


def read(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A table by its extension; compressed text files too. Columns of CSV files are strings unless a schema is given."""
    name = path.lower().removesuffix(".gz").removesuffix(".zst").removesuffix(".zstd").rstrip("/")
    reader = spark.read.schema(schema) if schema else spark.read
    if name.endswith((".csv", ".tsv")):
        return reader.csv(path, header=header, sep="\t" if name.endswith(".tsv") else ",", multiLine=True, escape='"')
    if name.endswith((".jsonl", ".ndjson")):
        return reader.json(path)
    if name.endswith(".json"):
        return reader.json(path, multiLine=True)
    if name.endswith(".orc"):
        return reader.orc(path)
    return reader.parquet(path) if name.endswith(".parquet") else spark.read.text(path)


def logical_type(kind: T.DataType) -> str:
    """integer, float, boolean, string, datetime, list or unknown."""
    for name, kinds in (("integer", T.IntegralType), ("float", (T.FloatType, T.DoubleType, T.DecimalType)), ("boolean", T.BooleanType), ("string", T.StringType), ("datetime", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("list", T.ArrayType)):
        if isinstance(kind, kinds):
            return name
    return "unknown"


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns cast to inferred types; cells that do not parse become NULL."""
    kinds = {"integer": "bigint", "float": "double", "boolean": "boolean"}
    return df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) as {kinds[t]})") for c, t in types.items() if t in kinds})


def feature_matrix(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(features array<float>, target): cells that do not parse are 0."""
    number = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` as float)"), F.lit(0.0).cast("float"))
    return df.select(F.array(*map(number, features)).alias("features"), number(target).alias("target"))


def with_row_index(df: DataFrame, order: Sequence[str]) -> DataFrame:
    from ..operators.splits import indexed

    return indexed(df, order)


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) in an order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def chunk(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    """Rows of one chunk, with row_index."""
    return with_row_index(df, order).filter((F.col("row_index") >= number * size) & (F.col("row_index") < (number + 1) * size))


def chunks(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """(chunk_index, start_row, end_row, rows, is_last)."""
    own = with_row_index(df, order).groupBy(F.floor(F.col("row_index") / size).alias("chunk_index")).agg(F.min("row_index").alias("start_row"), (F.max("row_index") + 1).alias("end_row"), F.count("*").alias("rows"))
    last = own.agg(F.max("chunk_index").alias("_l"))
    return own.crossJoin(F.broadcast(last)).select("chunk_index", "start_row", "end_row", "rows", (F.col("chunk_index") == F.col("_l")).alias("is_last"))


def rows_at(df: DataFrame, order: Sequence[str], places: Iterable[int]) -> DataFrame:
    """The rows at these places; places outside the table are ignored."""
    wanted = df.sparkSession.createDataFrame([(int(i),) for i in sorted(set(places))], "row_index long")
    return with_row_index(df, order).join(wanted, "row_index", "left_semi")


def masked(df: DataFrame, mask: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows whose place has keep = true in mask (row_index, keep)."""
    return with_row_index(df, order).join(mask.filter("keep"), "row_index", "left_semi").drop("row_index")


def search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the text in any cell, in any case; `__null__` finds rows with a NULL cell."""
    cells = columns or df.columns
    if text == "__null__":
        return df.filter(F.exists(F.array(*(F.col(c).isNull() for c in cells)), lambda x: x))
    return df.filter(F.exists(F.array(*(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells)), lambda x: F.contains(x, F.lit(text.lower()))))


def format_of(path: Column) -> Column:
    """The format by a path's extension, NULL if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, extensions in EXTENSIONS.items():
        out = F.when(suffix.isin(extensions.split()), name).otherwise(out)
    return out


def format_of_content(content: bytes) -> str | None:
    """The format by a file's first bytes."""
    import json

    for name, magic in MAGIC.items():
        if content.startswith(magic):
            return name
    try:
        text = content.decode()
    except UnicodeDecodeError:
        return None
    try:
        json.loads(text)
        return "json"
    except ValueError:
        return "csv" if "," in text and "\n" in text else "text"


def grid_sorted(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted by a column with NULL last either way."""
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))


def string_cells(df: DataFrame) -> DataFrame:
    """Every column as text; NULL is empty."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row, with NULL cells."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def missing_flags(df: DataFrame) -> DataFrame:
    """(column, missing): whether any cell is NULL or, as text, blank."""
    flags = [F.struct(F.lit(c).alias("column"), F.max((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").cast("int")).alias("any")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    return df.agg(*flags).select(F.explode(F.array(*(f"c{i}" for i in range(len(df.columns))))).alias("f")).select("f.column", (F.coalesce("f.any", F.lit(0)) == 1).alias("missing"))


class Chunks:
    """A table read chunk by chunk in an order: next, reset, position, exhausted."""

    def __init__(self, df: DataFrame, order: Sequence[str], rows: int):
        from ..operators.splits import indexed
        from ..storage import written

        self.columns, self.rows, self.total, self.position = df.columns, rows, df.count(), 0
        self.held = written(indexed(df.select(F.struct("*").alias("row"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(order))), [f"k{i}" for i in range(len(order))], "at").select("row", "at"))

    @property
    def exhausted(self) -> bool:
        return self.position >= self.total

    def reset(self) -> None:
        self.position = 0

    def next(self) -> tuple[int, int, int, bool, DataFrame] | None:
        """(chunk, first row, end, last one, rows), or None at the end. The rows are a filter on the places, pushed to the files."""
        if self.exhausted:
            return None
        a = self.position
        self.position = b = min(a + self.rows, self.total)
        return a // self.rows, a, b, b == self.total, self.held.filter((F.col("at") >= a) & (F.col("at") < b)).select("row.*")


def write_prepared(df: DataFrame, path: str, preview: int = 50) -> tuple[str, DataFrame]:
    """Write a prepared table beside its source, as <stem>_preprocessed with the same extension; (path, the first rows)."""
    stem, dot, end = path.rstrip("/").rpartition(".")
    out = f"{stem}_preprocessed.{end}" if dot and "/" not in end else f"{path.rstrip('/')}_preprocessed"
    writer = df.write.mode("overwrite")
    if end in ("csv", "tsv"):
        writer.csv(out, header=True, sep="\t" if end == "tsv" else ",")
    elif end in ("json", "jsonl", "ndjson"):
        writer.json(out)
    else:
        writer.parquet(out)
    return out, df.limit(preview)


def storage_problems(kind: str, bucket: str = "", region: str = "", endpoint: str = "") -> list[str]:
    """What a remote storage's settings lack: a bucket everywhere, a region for s3, an endpoint for custom stores and hdfs."""
    out = ["bucket"] * (not bucket and kind != "hdfs") + ["region"] * (kind == "s3" and not region)
    return out + ["endpoint"] * (kind in ("custom", "minio", "hdfs") and not endpoint) + ["kind"] * (kind not in ("s3", "gcs", "azure", "oss", "hdfs", "minio", "custom"))


def human_size(n: Column) -> Column:
    """B, KB, MB or GB; two decimals beyond bytes."""
    k = 1024.0
    return F.when(n < k, F.concat(n.cast("string"), F.lit(" B"))).when(n < k**2, F.format_string("%.2f KB", n / k)).when(n < k**3, F.format_string("%.2f MB", n / k**2)).otherwise(F.format_string("%.2f GB", n / k**3))


def inspect(spark: SparkSession, path: str, chunk_rows: int = 10_000) -> dict:
    """rows, columns, types and number of chunks."""
    df = read(spark, path)
    n = df.count()
    return {"rows": n, "columns": df.columns, "types": {f.name: logical_type(f.dataType) for f in df.schema}, "chunks": math.ceil(n / chunk_rows)}


def recommended_chunk(memory_mb: int, rows: int) -> int:
    """0.3 of the memory at 5000 rows a MB, from 1000 to 100,000, and no more than there are rows."""
    return min(max(min(int(0.3 * memory_mb * 5000), 100_000), 1000), max(rows, 1))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest): SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("digest"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, format) of files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", format_of(F.col("path")).alias("format"))


def validate(df: DataFrame, columns: Sequence[str] | None = None, rows: int | None = None, digest: str | None = None) -> list[tuple[str, str]]:
    """(severity, finding): missing columns and another content digest are errors; extra ones and other row counts are warnings."""
    from ..operators.dedup import dataset_digest

    out = [("error", "digest differs")] * (digest is not None and dataset_digest(df).first()["digest"] != digest)
    out += [("error", f"missing column: {c}") for c in columns or () if c not in df.columns]
    out += [("warning", f"extra column: {c}") for c in df.columns if columns and c not in columns]
    return out + [("warning", "row count differs")] * (rows is not None and df.count() != rows)


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local, remote: (key, size). (key, action): upload, download, conflict or unchanged."""
    both = local.select("key", F.col("size").alias("_l")).join(remote.select("key", F.col("size").alias("_r")), "key", "full")
    return both.select("key", F.when(F.col("_r").isNull(), "upload").when(F.col("_l").isNull(), "download").when(F.col("_l") != F.col("_r"), "conflict").otherwise("unchanged").alias("action"))


def object_url(kind: str, bucket: str, key: str, prefix: str = "", region: str = "us-east-1", endpoint: str = "") -> str:
    """The address of an object: s3, gcs, oss or a custom endpoint."""
    path = "/".join(p.strip("/") for p in (prefix, key) if p.strip("/"))
    if kind == "gcs":
        return f"https://storage.googleapis.com/{bucket}/{path}"
    host = {"s3": f"{bucket}.s3.{region}.amazonaws.com", "oss": f"{bucket}.oss-{region}.aliyuncs.com"}.get(kind)
    return f"https://{host}/{path}" if host else f"{endpoint.rstrip('/')}/{bucket}/{path}"


def transfer(size: int, megabits: float) -> tuple[float, int]:
    """Seconds of a transfer, and the parallel streams advised."""
    s = size / (megabits * 125_000)
    return s, 8 if s > 3600 else 4 if s > 600 else 2 if s > 60 else 1


#: Storage class by access pattern, price a month of 10**9 bytes, price of retrieval.
STORAGE_CLASSES = {"frequent": ("STANDARD", 0.023, 0.0), "infrequent": ("STANDARD_IA", 0.0125, 0.01), "archive": ("GLACIER", 0.004, 0.01), "training": ("STANDARD", 0.023, 0.0)}


def storage_class(pattern: str, size: int) -> tuple[str, float, float]:
    """(class, cost a month, price of retrieval) for an access pattern and a size in bytes."""
    name, price, retrieval = STORAGE_CLASSES[pattern]
    return name, size / 1e9 * price, retrieval


class Connectors:
    """Readers by address prefix, the latest registered first."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {"": read}

    def register(self, prefix: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
        self.readers[prefix] = reader

    def load(self, spark: SparkSession, uri: str) -> DataFrame:
        return next(f for p, f in reversed(self.readers.items()) if uri.startswith(p))(spark, uri)
