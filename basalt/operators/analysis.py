"""Drift, correlation, imbalance, leakage, slices, bias, row differences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level(x: Column, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] for the first bound that x is under, else the last name."""
    out = F.lit(names[-1])
    for b, n in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(x < b, n).otherwise(out)
    return out


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, change, from_type, to_type) of added, removed and retyped columns."""
    spark = old.sparkSession
    table = lambda df, n: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], f"column string, {n} string")
    both = table(old, "from_type").join(table(new, "to_type"), "column", "full")
    return both.withColumn("change", F.when(F.col("from_type").isNull(), "added").when(F.col("to_type").isNull(), "removed").when(F.col("from_type") != F.col("to_type"), "retyped")).filter("change is not null").select("column", "change", "from_type", "to_type")


def psi_estimate(m0: Column, s0: Column, m1: Column, s1: Column) -> Column:
    """Half the squared mean shift in old deviations plus half the log ratio of deviations, each at most 10."""
    a, b = F.greatest(F.coalesce(s0, F.lit(1.0)), F.lit(1e-10)), F.greatest(F.coalesce(s1, F.lit(1.0)), F.lit(1e-10))
    return 0.5 * F.pow(F.least(F.abs(m1 - m0) / a, F.lit(10.0)), 2) + 0.5 * F.least(F.abs(F.log(b / a)), F.lit(10.0))


def distribution_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: column profiles. (column, drift, value, severity) for null rates, cardinality and distribution."""
    o, n = old.select("column", *(F.col(c).alias(f"o_{c}") for c in old.columns if c != "column")), new.select("column", *(F.col(c).alias(f"n_{c}") for c in new.columns if c != "column"))
    j = o.join(n, "column")
    nulls = F.abs(F.col("n_nulls") / F.col("n_total") - F.col("o_nulls") / F.col("o_total"))
    card = F.abs(F.col("n_distinct") - F.col("o_distinct")) / F.greatest(F.col("o_distinct"), F.lit(1))
    rel = lambda a, b: F.abs(b - a) / F.when(F.abs(a) > 1e-10, F.abs(a)).otherwise(1.0)
    psi = psi_estimate(F.col("o_mean"), F.col("o_std"), F.col("n_mean"), F.col("n_std"))
    moved = (rel(F.col("o_mean"), F.col("n_mean")) > 0.1) | (rel(F.col("o_std"), F.col("n_std")) > 0.2) | (psi > 0.1)
    found = F.array(
        F.when(nulls > 0.01, F.struct(F.lit("null_rate").alias("drift"), nulls.alias("value"), level(nulls, (0.05, 0.15), ("low", "medium", "high")).alias("severity"))),
        F.when(card > 0.1, F.struct(F.lit("cardinality").alias("drift"), card.alias("value"), level(card, (0.3, 0.5), ("low", "medium", "high")).alias("severity"))),
        F.when(moved & (psi >= 0.1), F.struct(F.lit("distribution").alias("drift"), psi.alias("value"), level(psi, (0.25, 0.5), ("low", "medium", "high")).alias("severity"))),
    )
    return j.select("column", F.explode(F.array_compact(found)).alias("d")).select("column", "d.*")


def volume_drift(old_rows: int, new_rows: int) -> tuple[float, str]:
    """Change in percent, and its severity."""
    percent = (new_rows / old_rows - 1) * 100 if old_rows else 0.0
    return percent, next(n for b, n in ((5, "none"), (20, "low"), (50, "medium"), (math.inf, "high")) if abs(percent) < b)


def psi(old: DataFrame, new: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row, psi: the population stability index over equal-width bins of the old range."""
    x = F.col(column).cast("double")
    ends = old.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))

    def share(df: DataFrame, name: str) -> DataFrame:
        b = F.least(F.greatest(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
        counts = df.filter(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).count()
        total = counts.agg(F.sum("count").alias("_t"))
        return counts.crossJoin(F.broadcast(total)).select("bin", (F.col("count") / F.col("_t")).alias(name))

    p, q = F.coalesce("p", F.lit(1e-4)), F.coalesce("q", F.lit(1e-4))
    return share(old, "p").join(share(new, "q"), "bin", "full").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson's r of every pair, in one pass."""
    pairs = list(combinations(columns, 2))
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    return df.agg(*aggs).select(F.explode(F.array(*(f"_{i}" for i in range(len(pairs))))).alias("p")).select("p.*")


def high_correlations(r: DataFrame) -> DataFrame:
    strong = F.abs("r")
    return r.filter(strong > 0.7).withColumn("severity", F.when(strong > 0.95, "high").when(strong > 0.85, "medium").otherwise("low"))


def target_ranking(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, r, rank) by absolute correlation with the target."""
    aggs = [F.struct(F.lit(f).alias("feature"), F.corr(f, target).alias("r")).alias(f"_{i}") for i, f in enumerate(features)]
    rows = df.agg(*aggs).select(F.explode(F.array(*(f"_{i}" for i in range(len(features))))).alias("p")).select("p.*")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "feature")))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """classes, n, ratio of the largest to the smallest, k / sum(1 / p) * n, level."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).count()
    total = counts.agg(F.sum("count").alias("_t"))
    own = counts.crossJoin(F.broadcast(total)).agg(F.count("*").alias("classes"), F.max("_t").alias("n"), (F.max("count") / F.min("count")).alias("ratio"), (F.count("*") / F.sum(F.col("_t") / F.col("count")) * F.max("_t")).alias("effective"))
    r = F.col("ratio")
    return own.withColumn("level", F.when(r <= 1.5, "balanced").when(r <= 3, "mild").when(r <= 10, "moderate").when(r <= 50, "severe").otherwise("extreme"))


def split_leakage(df: DataFrame, split: str, key: str) -> DataFrame:
    """(a, b, shared, share, severity): keys that stand in two splits, over the smaller one."""
    keys = df.select(F.col(split).alias("s"), F.col(key).alias("k")).distinct()
    sizes = keys.groupBy("s").agg(F.count("*").alias("n"))
    both = keys.select(F.col("s").alias("a"), "k").join(keys.select(F.col("s").alias("b"), "k"), "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = both.join(sizes.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    share = F.col("shared") / F.least("na", "nb")
    return n.select("a", "b", "shared", share.alias("share"), F.when(share > 0.05, "critical").otherwise("warning").alias("severity"))


def row_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """(change, n): added, removed, modified and unchanged rows by key; rows compare by all their columns."""
    h = lambda df, n: df.select(*key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias(n))
    both = h(old, "_o").join(h(new, "_n"), list(key), "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("unchanged")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def slice_stats(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(slice, column, rows, nulls, distinct, mean, std): sample deviation; one row a slice and column."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.count_distinct(F.col(c)).alias("distinct"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(f"_{i}") for i, c in enumerate(columns)]
    return df.groupBy(F.col(by).alias("slice")).agg(*aggs).select("slice", F.explode(F.array(*(f"_{i}" for i in range(len(columns))))).alias("s")).select("slice", "s.*")


def label_shift(df: DataFrame, by: str, label: str) -> DataFrame:
    """(a, b, shift): total variation between the label shares of every two slices."""
    counts = df.groupBy(F.col(by).alias("s"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("s"))).select("s", "l", "p")
    slices, labels = p.select("s").distinct(), p.select("l").distinct()
    full = slices.crossJoin(labels).join(p, ["s", "l"], "left").fillna(0.0, ["p"])
    pairs = full.select(F.col("s").alias("a"), "l", F.col("p").alias("pa")).join(full.select(F.col("s").alias("b"), "l", F.col("p").alias("pb")), "l").filter("a < b")
    return pairs.groupBy("a", "b").agg((0.5 * F.sum(F.abs(F.col("pa") - F.col("pb")))).alias("shift"))


def group_bias(df: DataFrame, attributes: Sequence[str], positive: Column) -> DataFrame:
    """(group values, n, share, positive_rate, representation_gap) by the attributes' combinations, without empty ones."""
    rows = df
    for a in attributes:
        rows = rows.filter(F.col(a).isNotNull() & (F.col(a).cast("string") != ""))
    total = df.agg(F.count("*").alias("_t"))
    groups = rows.groupBy(*attributes).agg(F.count("*").alias("n"), F.avg(positive.cast("double")).alias("positive_rate"))
    k = groups.agg(F.count("*").alias("_k"))
    return groups.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(k)).select(*attributes, "n", (F.col("n") / F.col("_t")).alias("share"), "positive_rate", (F.col("n") / F.col("_t") - 1 / F.col("_k")).alias("representation_gap"))


def parity(groups: DataFrame) -> DataFrame:
    """difference and ratio of the extreme positive rates (NULL ratio if the smallest is 0), fair, level."""
    d, r = F.max("positive_rate") - F.min("positive_rate"), F.when(F.min("positive_rate") > 0, F.max("positive_rate") / F.min("positive_rate"))
    own = groups.agg(d.alias("difference"), r.alias("ratio"))
    fair = (F.col("difference") < 0.1) & F.coalesce(F.col("ratio").between(0.8, 1.25), F.lit(False))
    return own.withColumn("fair", fair).withColumn("level", level(F.col("difference"), (0.05, 0.1, 0.2, 0.3), ("none", "low", "medium", "high", "critical")))


def sufficiency(rows: int, parameters: int, features: int, classes: int, factor: int = 10) -> tuple[int, bool]:
    """Rows that a model asks for, and whether there are enough."""
    need = max(parameters * factor, features * 50, classes * 100)
    return need, rows >= need
