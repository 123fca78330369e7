"""Preprocessing steps: fitted in one aggregation, applied as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import is_numeric


def _stats(df: DataFrame, columns: Sequence[str], *fs: Callable[[Column], Column]) -> dict[str, tuple]:
    if not columns:
        return {}
    row = df.agg(*(f(F.col(c)).alias(f"{i}_{j}") for i, c in enumerate(columns) for j, f in enumerate(fs))).first()
    return {c: tuple(row[f"{i}_{j}"] for j in range(len(fs))) for i, c in enumerate(columns)}


def nan_as_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN, which matrices take for a missing value, as NULL, which the steps below do."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def null_as_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns})


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); 0 where the range is nearly 0. NULL stays."""
    out = {}
    for c, (low, high) in _stats(df, columns, F.min, F.max).items():
        flat = low is None or abs(high - low) < 1e-10
        out[c] = F.when(F.col(c).isNull(), None).otherwise(F.lit(0.0) if flat else (F.col(c) - F.lit(low)) / F.lit(float(high - low)))
    return df.withColumns(out)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; 0 where the deviation is nearly 0. NULL stays."""
    out = {}
    for c, (mean, std) in _stats(df, columns, F.avg, F.stddev_pop).items():
        flat = mean is None or std < 1e-10
        out[c] = F.when(F.col(c).isNull(), None).otherwise(F.lit(0.0) if flat else (F.col(c) - F.lit(mean)) / F.lit(std))
    return df.withColumns(out)


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _mode(df: DataFrame, column: str):
    row = df.filter(~_blank(column)).groupBy(column).count().orderBy(F.desc("count"), column).first()
    return None if row is None else row[0]


def fill_missing(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> DataFrame:
    """Numbers by mean, median, zero, min or max; other columns, and strategy mode, by the most frequent value."""
    fs = {"mean": F.avg, "median": F.median, "zero": lambda c: F.lit(0.0), "min": F.min, "max": F.max}
    if strategy not in (*fs, "mode"):
        raise ValueError(f"unknown strategy: {strategy}")
    numbers = [c for c in columns if is_numeric(df, c) and strategy != "mode"]
    fills = {c: v[0] for c, v in _stats(df, numbers, fs.get(strategy, F.avg)).items()}
    fills |= {c: _mode(df, c) for c in columns if c not in fills}
    return df.withColumns({c: F.when(_blank(c), F.lit(v)).otherwise(F.col(c)) for c, v in fills.items() if v is not None})


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any NULL or blank cell."""
    for c in columns or df.columns:
        df = df.filter(~_blank(c))
    return df


#: Categories of a one-hot column at most.
CATEGORIES = 100


def _categories(df: DataFrame, column: str, most: int) -> list:
    found = [r[0] for r in df.filter(~_blank(column)).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return found


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column replaced, in place, by one 0/1 column a category, categories sorted."""
    out: list[Column] = []
    for c in df.columns:
        if c in columns:
            out += [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in _categories(df, c, CATEGORIES)]
        else:
            out.append(F.col(c))
    return df.select(*out)


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """The column replaced by its value's place among the sorted distinct values, from 0. Blank cells get none."""
    codes = df.filter(~_blank(column)).select(column).distinct().withColumn("_code", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return df.join(codes, column, "left").withColumn(column, F.col("_code")).drop("_code").select(*df.columns)


def tokenize_column(df: DataFrame, column: str, row: str) -> DataFrame:
    """Adds <column>_tokenized: comma-joined ids of the lower-case words, numbered from 2 by first appearance.

    row orders the rows. 0 is the unknown and 1 the padding token.
    """
    from ..functions.text import simple_tokens

    words = df.select(F.col(row).alias("_row"), F.posexplode(simple_tokens(F.col(column))).alias("_pos", "_word"))
    first = words.groupBy("_word").agg(F.min(F.struct("_row", "_pos")).alias("_first"))
    ids = first.select("_word", (F.row_number().over(Window.orderBy("_first")) + 1).alias("_id"))
    joined = words.join(ids, "_word").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_id"))).alias("_l"))
    got = joined.select("_row", F.array_join(F.transform("_l", lambda x: x["_id"].cast("string")), ",").alias(f"{column}_tokenized"))
    return df.join(got, df[row] == got["_row"], "left").drop("_row").withColumn(f"{column}_tokenized", F.coalesce(f"{column}_tokenized", F.lit("")))


def pad_sequence(ids: Column, length: int = 128, pad: str = "0") -> Column:
    """A comma-joined list cut or padded to a length."""
    parts = F.filter(F.split(ids, ","), lambda x: x != "")
    return F.array_join(F.slice(F.concat(parts, F.array_repeat(F.lit(pad), length)), 1, length), ",")


#: Steps by name; register() adds one.
STEPS: dict[str, Callable[..., DataFrame]] = {"normalize": normalize, "standardize": standardize, "fill_missing": fill_missing, "drop_missing": drop_missing, "one_hot": one_hot, "label_encode": label_encode, "tokenize": tokenize_column}


def register(name: str, step: Callable[..., DataFrame]) -> None:
    STEPS[name] = step


def run_steps(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """Named steps with their arguments, in order; an unknown step raises."""
    for name, arguments in steps:
        if name not in STEPS:
            raise ValueError(f"unsupported step: {name}")
        df = STEPS[name](df, **arguments)
    return df


def clean_text(text: Column, strip: bool = True, lower: bool = False, urls: bool = False, emails: bool = False, phones: bool = False) -> Column:
    """The text options of a preprocessing plan."""
    from ..functions.text import PII, URL

    for on, pattern in ((urls, URL), (emails, PII["email"]), (phones, PII["phone"])):
        text = F.regexp_replace(text, pattern, "") if on else text
    text = F.lower(text) if lower else text
    return F.trim(text) if strip else text
