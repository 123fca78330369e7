"""Slices of a table by predicates over its cells as text, their statistics and quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell that is a number.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ORDER = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b}


def cell(value: Column) -> Column:
    """A value as text; NULL is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _compared(value: Column, target: str, op: str) -> Column:
    """By number if both sides are numbers, else by text."""
    a, b = _number(value), _number(F.lit(target))
    return F.when(a.isNotNull() & b.isNotNull(), _ORDER[op](a, b)).otherwise(_ORDER[op](value, F.lit(target)))


def matches(value: Column, op: str, target: str = "") -> Column:
    """Whether a cell matches: eq, neq, gt, lt, ge, le, contains, in ("a, b"), between ("lo, hi", both included), is_null,
    is_not_null. Empty cells and the words null and NULL are null."""
    v = cell(value)
    null = v.isin("", "null", "NULL")
    if op in _ORDER:
        return _compared(v, target, op)
    if op == "between":
        parts = [p.strip() for p in target.split(",")]
        if len(parts) != 2:
            return F.lit(False)
        numbers = reduce(lambda a, b: a & b, (_number(x).isNotNull() for x in (v, *map(F.lit, parts))))
        lo, hi = parts
        return F.when(numbers, (_number(v) >= _number(F.lit(lo))) & (_number(v) <= _number(F.lit(hi)))).otherwise((v >= lo) & (v <= hi))
    simple = {"eq": lambda: v == target, "neq": lambda: v != target, "contains": lambda: F.contains(v, F.lit(target)), "in": lambda: v.isin([t.strip() for t in target.split(",")]), "is_null": lambda: null, "is_not_null": lambda: ~null}
    return simple[op]()


def sliced(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """df with a column slice: each row once for every predicate it meets, in one pass."""
    return df.withColumn("slice", F.explode(F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in predicates.items())))))


def extremes(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(slice, column, lowest, highest): the first and last cell of each column as text, without empty ones."""
    aggs = [F.struct(F.lit(c).alias("column"), F.min(F.when(cell(F.col(c)) != "", cell(F.col(c)))).alias("lowest"), F.max(cell(F.col(c))).alias("highest")).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.groupBy(F.col(by).alias("slice")).agg(*aggs).select("slice", F.explode(F.array(*(f"c{i}" for i in range(len(columns))))).alias("s")).select("slice", "s.*")


def quality(df: DataFrame, predicates: dict[str, Column], columns: Sequence[str], label: str | None = None) -> DataFrame:
    """(slice, rows, completeness, balance, representativeness, score): 1 less the mean null rate; 1 less the spread of the
    label shares; by the slice's share of all rows. Weights 0.4, 0.3, 0.3. Slices without rows do not appear."""
    rows = sliced(df, predicates)
    nulls = reduce(lambda a, b: a + b, (F.count_if(matches(F.col(c), "is_null")) for c in columns)) if columns else F.lit(0)
    own = rows.groupBy("slice").agg(F.count("*").alias("rows"), (F.lit(1.0) - nulls / (F.count("*") * max(len(columns), 1))).alias("completeness"))
    total = df.agg(F.count("*").alias("total"))
    if label is None:
        own = own.withColumn("balance", F.lit(1.0))
    else:
        counts = rows.filter(cell(F.col(label)) != "").groupBy("slice", cell(F.col(label)).alias("label")).count()
        spread = counts.groupBy("slice").agg(((F.max("count") - F.min("count")) / F.sum("count")).alias("spread"))
        own = own.join(spread, "slice", "left").withColumn("balance", 1 - F.coalesce("spread", F.lit(0.0))).drop("spread")
    share = F.col("rows") / F.col("total")
    got = own.crossJoin(F.broadcast(total)).withColumn("representativeness", F.when(share < 0.01, 0.3).when(share < 0.05, 0.6).when(share < 0.1, 0.8).otherwise(1.0))
    return got.select("slice", "rows", "completeness", "balance", "representativeness", (0.4 * F.col("completeness") + 0.3 * F.col("balance") + 0.3 * F.col("representativeness")).alias("score"))
