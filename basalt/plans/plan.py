"""A small plan algebra compiled to lazy DataFrames.

Predicates are two-valued: a comparison with NULL is false, and so Neq, NotIn and Not keep NULL rows. An operation sees
the columns that the one before it left; unknown columns raise.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_key

#: Doubles are equal within this distance.
FLOAT_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Filter:
    """operator: Eq Neq Gt Gte Lt Lte Contains StartsWith EndsWith In NotIn IsNull IsNotNull Regex Between."""

    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class And:
    conditions: Sequence[Any] = ()


@dataclass(frozen=True)
class Or:
    conditions: Sequence[Any] = ()


@dataclass(frozen=True)
class Not:
    condition: Any


@dataclass(frozen=True)
class Project:
    columns: Sequence[str]


@dataclass(frozen=True)
class Sort:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class Limit:
    count: int
    offset: int = 0


@dataclass(frozen=True)
class Sample:
    """ceil(n * fraction) rows by hash order of the key columns."""

    fraction: float
    key: Sequence[str]
    seed: str = "42"


@dataclass(frozen=True)
class Agg:
    function: str
    column: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}_{self.column}"


@dataclass(frozen=True)
class Aggregate:
    aggregations: Sequence[Agg]
    group_by: Sequence[str] = ()


@dataclass(frozen=True)
class Distinct:
    """Whole rows; with columns, the first row a key by order_by."""

    columns: Sequence[str] = ()
    order_by: Sequence[str] = ()


@dataclass(frozen=True)
class Plan:
    operations: Sequence[Any] = field(default_factory=tuple)


def predicate(df: DataFrame, condition: Any) -> Column:
    """The condition as a boolean column that is never NULL."""
    if isinstance(condition, And):
        return reduce(lambda a, b: a & b, (predicate(df, c) for c in condition.conditions), F.lit(True))
    if isinstance(condition, Or):
        parts = [predicate(df, c) for c in condition.conditions]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)
    if isinstance(condition, Not):
        return ~predicate(df, condition.condition)
    return _compare(df, condition)


def _literal(kind: T.DataType, value: Any) -> Column:
    """value typed as a column; text that does not parse raises."""
    if isinstance(kind, (T.IntegralType,)):
        return F.lit(int(value))
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.lit(float(value))
    if isinstance(kind, T.BooleanType):
        return F.lit(value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()])
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.lit(str(value)).cast(kind)
    return F.lit(str(value))


def _compare(df: DataFrame, f: Filter) -> Column:
    column, kind, op = F.col(f.column), df.schema[f.column].dataType, f.operator
    no, floats = lambda c: F.coalesce(c, F.lit(False)), isinstance(kind, (T.DoubleType, T.FloatType))
    if op == "IsNull":
        return column.isNull()
    if op == "IsNotNull":
        return column.isNotNull()
    if op in ("In", "NotIn"):
        values = json.loads(f.value) if isinstance(f.value, str) else list(f.value)
        inside = no(column.isin([_literal(kind, v) for v in values])) if values else F.lit(False)
        return inside if op == "In" else ~inside
    if op == "Between":
        low, high = f.value
        return no(column.between(_literal(kind, low), _literal(kind, high)))
    if op in ("Contains", "StartsWith", "EndsWith", "Regex"):
        value = F.lit(str(f.value))
        return no({"Contains": column.contains, "StartsWith": column.startswith, "EndsWith": column.endswith, "Regex": lambda v: F.regexp_like(column, v)}[op](value))
    value = _literal(kind, f.value)
    same = F.abs(column - value) < FLOAT_TOLERANCE if floats else column == value
    if op in ("Eq", "Neq"):
        return no(same) if op == "Eq" else ~no(same)
    return no({"Gt": column > value, "Gte": column >= value, "Lt": column < value, "Lte": column <= value}[op])


def aggregate(df: DataFrame, op: Aggregate) -> DataFrame:
    """Doubles; nothing to aggregate gives 0. Grouped count counts rows and distinct_count counts NULL as a value;
    global ones don't."""
    grouped = bool(op.group_by)

    def one(a: Agg) -> Column:
        df.schema[a.column]
        c = F.col(a.column)
        x = c.cast("double")
        got = {
            "count": lambda: F.count(F.lit(1)) if grouped else F.count(c),
            "sum": lambda: F.sum(x),
            "mean": lambda: F.avg(x),
            "min": lambda: F.min(x),
            "max": lambda: F.max(x),
            "std_dev": lambda: F.stddev_samp(x),
            "distinct_count": lambda: F.count_distinct(c) + (F.max(c.isNull().cast("int")) if grouped else F.lit(0)),
        }[a.function]()
        return F.coalesce(got.cast("double"), F.lit(0.0)).alias(a.name)

    columns = [one(a) for a in op.aggregations]
    return df.groupBy(*op.group_by).agg(*columns) if grouped else df.agg(*columns)


def sample(df: DataFrame, fraction: float, key: Sequence[str], seed: str = "42") -> DataFrame:
    """Exactly ceil(n * fraction) rows, the ones with the smallest hashes of their key.

    The cut is found by a top-k over hashes alone, so no task ranks all rows.
    """
    n = df.count()
    k = math.ceil(n * fraction)
    hashed = df.withColumn("_h", hash_key(seed, F.concat_ws("|", *(F.col(c).cast("string") for c in key))))
    if k >= n:
        return df
    order = ["_h", *key]
    cut = hashed.select(*order).orderBy(*order).offset(max(k - 1, 0)).limit(1).collect() if k else []
    if not cut:
        return df.limit(0)
    bound = F.struct(*(F.lit(v).cast(hashed.schema[c].dataType).alias(c) for c, v in zip(order, cut[0], strict=True)))
    return hashed.filter(F.struct(*order) <= bound).drop("_h")


def distinct(df: DataFrame, columns: Sequence[str] = (), order_by: Sequence[str] = ()) -> DataFrame:
    if not columns:
        return df.distinct()
    rank = F.row_number().over(Window.partitionBy(*columns).orderBy(*(order_by or df.columns)))
    return df.withColumn("_n", rank).filter("_n = 1").drop("_n")


def compile_plan(plan: Plan | Sequence[Any], df: DataFrame) -> DataFrame:
    """The plan over df, lazily; operations keep their order."""
    for op in plan.operations if isinstance(plan, Plan) else plan:
        if isinstance(op, (Filter, And, Or, Not)):
            df = df.filter(predicate(df, op))
        elif isinstance(op, Project):
            df = df.select(*(F.col(c) for c in op.columns))
        elif isinstance(op, Sort):
            df = df.orderBy(F.col(op.column).asc_nulls_first() if op.ascending else F.col(op.column).desc_nulls_last())
        elif isinstance(op, Limit):
            df = (df.offset(op.offset) if op.offset else df).limit(op.count)
        elif isinstance(op, Sample):
            df = sample(df, op.fraction, op.key, op.seed)
        elif isinstance(op, Aggregate):
            df = aggregate(df, op)
        elif isinstance(op, Distinct):
            df = distinct(df, op.columns, op.order_by)
        else:
            raise TypeError(f"not an operation: {op!r}")
    return df


def from_json(text: str) -> Plan:
    """A plan from its JSON form: a list of one-key objects, {"Filter": {...}} and so on."""
    kinds = {c.__name__: c for c in (Filter, And, Or, Not, Project, Sort, Limit, Sample, Aggregate, Distinct)}

    def read(x: dict[str, Any]) -> Any:
        ((name, body),) = x.items()
        body = dict(body)
        if name in ("And", "Or"):
            body["conditions"] = tuple(map(read, body["conditions"]))
        if name == "Not":
            body["condition"] = read(body["condition"])
        if name == "Aggregate":
            body["aggregations"] = tuple(Agg(**a) for a in body["aggregations"])
        return kinds[name](**body)

    return Plan(tuple(map(read, json.loads(text))))


#: Cost a row of an operation, for a rough comparison of plans.
COSTS = {"Filter": 0.01, "And": 0.01, "Or": 0.01, "Not": 0.01, "Aggregate": 0.1, "Distinct": 0.05}


def estimated_cost(plan: Plan, rows: int) -> float:
    """Sum over the operations of cost times rows; a sort costs ln n a row, others 0.001."""
    return sum(rows * (math.log(max(rows, 1)) if isinstance(op, Sort) else COSTS.get(type(op).__name__, 0.001)) for op in plan.operations)
