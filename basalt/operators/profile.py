"""Column profiles and statistics: one aggregation a table, whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, FLOAT, BOOL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"(?i)^(true|false)$"


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def column_profiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: column, total, nulls, distinct, min, max, mean, std (population), median; numbers only where numeric."""
    columns = columns or df.columns
    aggs = []
    for c in columns:
        x = F.col(c).cast("double") if is_numeric(df, c) else F.lit(None).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.count_distinct(F.col(c)).alias("distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, F.lit(0.5)).alias("median")).alias(f"_{len(aggs)}"))
    return df.agg(*aggs).select(F.explode(F.array(*(f"_{i}" for i in range(len(aggs))))).alias("p")).select("p.*")


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """total, nulls, distinct, min, max, mean of a numeric column, and the values at the places n/4, n/2 and 3n/4 of its
    sorted values (from 0).

    The places are found by exact percentiles, whose partial aggregates hold one entry a distinct value.
    """
    x = F.col(column).cast("double")
    base = df.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count(x)).alias("nulls"), F.count_distinct(x).alias("distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
    n = df.agg(F.count(x)).first()[0]
    # percentile interpolates between places (n - 1) * p: exact at a place itself
    at = [(name, min(n * q // 4, n - 1) / (n - 1) if n > 1 else 0.0) for q, name in ((1, "q25"), (2, "median"), (3, "q75"))]
    return base.crossJoin(df.agg(*(F.percentile(x, F.lit(p)).alias(name) for name, p in at)))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths, the last bin closed. A constant or empty column has none. Empty bins are left out."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    own = df.filter(x.isNotNull()).select(x.alias("x")).crossJoin(F.broadcast(ends)).filter("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    binned = own.select(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"), "lo", width.alias("w"))
    return binned.groupBy("bin", "lo", "w").count().select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.col("count").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, n): the k most frequent non-null values, ties to the smaller one."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def strict_types(df: DataFrame) -> DataFrame:
    """(column, type) of string columns: every non-empty value parses, as integer, then float, then boolean; else string."""
    return _typed(df, 1.0, strict=True)


def majority_types(df: DataFrame, share: float = 0.8) -> DataFrame:
    """(column, type): more than `share` of the non-empty values parse; few distinct values are categorical; none: unknown."""
    return _typed(df, share, strict=False)


def _typed(df: DataFrame, share: float, strict: bool) -> DataFrame:
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(c).cast("string"))
        some = F.coalesce(v != "", F.lit(False))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(some).alias("n"), F.count_if(some & v.rlike(INT)).alias("i"), F.count_if(some & v.rlike(FLOAT)).alias("f"), F.count_if(some & v.rlike(BOOL)).alias("b"), F.count_distinct(F.when(some, v)).alias("d")).alias(f"_{i}"))
    rows = df.agg(*aggs).select(F.explode(F.array(*(f"_{i}" for i in range(len(aggs))))).alias("p")).select("p.*")
    enough = lambda k: (F.col(k) == F.col("n")) if strict else (F.col(k) > share * F.col("n"))
    kind = F.when(F.col("n") == 0, "string" if strict else "unknown").when(enough("i"), "integer").when(enough("f"), "float").when(enough("b"), "boolean")
    if not strict:
        kind = kind.when((F.col("d") <= 20) & (F.col("d") < F.col("n") / 2), "categorical")
    return rows.select("column", kind.otherwise("string").alias("type"))
