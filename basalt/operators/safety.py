"""Is a table safe to train on: leaks between splits and from features, class shares of splits, collinear columns, readiness."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def leakage(df: DataFrame, split: str, key: str) -> DataFrame:
    """One row: keys of each split, keys in two splits, severity. Keys are reduced to three flags, so nothing is joined.

    train and test: critical if over 5 % of the smaller one is shared, else high; any other overlap is low.
    """
    flags = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.max((F.col(split) == s).cast("int")).alias(s) for s in SPLITS))
    sizes = [F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}_keys") for s in SPLITS]
    pairs = [F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_{b}") for a, b in combinations(SPLITS, 2)]
    share = F.col("train_test") / F.greatest(F.least("train_keys", "test_keys"), F.lit(1))
    severity = F.when(F.col("train_test") > 0, F.when(share > 0.05, "critical").otherwise("high")).when((F.col("train_val") > 0) | (F.col("val_test") > 0), "low").otherwise("none")
    return flags.agg(*sizes, *pairs).withColumn("severity", severity)


def feature_leakage(profiles: DataFrame, target: str) -> DataFrame:
    """(column, risk) of suspicious columns. profiles: (column, total, distinct, mean, values): mean of numeric columns, most
    frequent values of categorical ones, else NULL.

    high: its name holds the target's or the other way round; medium: a unique id; critical or high: its mean within 5 % or
    15 % of the target's; high: over 0.8 of the values in common.
    """
    t = profiles.filter(F.col("column") == target).select(F.col("mean").alias("t_mean"), F.col("values").alias("t_values"))
    rows = profiles.filter(F.col("column") != target).crossJoin(F.broadcast(t))
    name, wanted = F.lower("column"), target.lower()
    named = (F.contains(name, F.lit(wanted)) | F.contains(F.lit(wanted), name)) & (name != wanted)
    unique = F.contains(name, F.lit("id")) & (F.col("distinct") == F.col("total"))
    risk = F.when(unique, 1).when(named, 2).otherwise(0)
    near = F.when(F.abs("t_mean") > 1e-10, 1 - F.abs(F.col("mean") - F.col("t_mean")) / F.abs("t_mean")).otherwise(0.0)
    near = F.coalesce(near, F.lit(0.0))
    risk = F.when(near > 0.95, 3).when(near > 0.85, F.greatest(risk, F.lit(2))).otherwise(risk)
    shared = F.size(F.array_intersect("values", "t_values")) / F.greatest(F.least(F.size("values"), F.size("t_values")), F.lit(1))
    risk = F.when(F.col("values").isNotNull() & F.col("t_values").isNotNull() & (shared > 0.8), F.greatest(risk, F.lit(2))).otherwise(risk)
    return rows.select("column", F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), risk + 1).alias("risk")).filter("risk <> 'low'")


def class_shares(df: DataFrame, split: str, label: str) -> DataFrame:
    """(class, train, val, test, deviation): each class's share of the splits, and the largest difference of two of them."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(*(F.count_if(F.col(split) == s).alias(s) for s in SPLITS))
    totals = counts.agg(*(F.sum(s).alias(f"all_{s}") for s in SPLITS))
    shares = counts.crossJoin(F.broadcast(totals)).select("class", *(F.when(F.col(f"all_{s}") > 0, F.col(s) / F.col(f"all_{s}")).otherwise(0.0).alias(s) for s in SPLITS))
    return shares.withColumn("deviation", F.greatest(*(F.abs(F.col(a) - F.col(b)) for a, b in combinations(SPLITS, 2))))


def consistency(shares: DataFrame) -> DataFrame:
    """One row from class shares: the stability index of each two splits, and whether all are under 0.1."""
    psi = lambda a, b: F.sum((F.greatest(b, F.lit(1e-4)) - F.greatest(a, F.lit(1e-4))) * F.log(F.greatest(b, F.lit(1e-4)) / F.greatest(a, F.lit(1e-4))))
    got = shares.agg(*(psi(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in combinations(SPLITS, 2)))
    return got.withColumn("consistent", F.greatest(*(f"{a}_{b}" for a, b in combinations(SPLITS, 2))) < 0.1)


def profile_health(profiles: DataFrame) -> DataFrame:
    """One row, data_quality from 0 to 100: the mean over columns of 0.6 times a score of the null rate and 0.4 times one that
    marks columns of almost only different values."""
    rate, distinct = F.col("nulls") / F.greatest("total", F.lit(1)), F.col("distinct") / F.greatest("total", F.lit(1))
    null_score = F.when(rate < 0.01, 100.0).when(rate < 0.05, 80.0).when(rate < 0.10, 60.0).when(rate < 0.30, 30.0).otherwise(0.0)
    distinct_score = F.when((distinct > 0.9) & (F.col("distinct") > 100), 30.0).otherwise(100.0)
    return profiles.agg(F.coalesce(F.avg(0.6 * null_score + 0.4 * distinct_score), F.lit(50.0)).alias("data_quality"))


def balance_health(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, balance_health from 0 to 100: the mean over the columns of a score of the largest over the smallest class."""
    one = lambda c: df.filter(F.col(c).isNotNull()).groupBy(c).count().agg((F.max("count") / F.min("count")).alias("ratio"))
    r = F.col("ratio")
    score = F.when(r.isNull() | (r <= 1.5), 100.0).when(r <= 3, 80.0).when(r <= 10, 50.0).when(r <= 50, 20.0).otherwise(0.0)
    return reduce(DataFrame.unionByName, map(one, columns)).agg(F.avg(score).alias("balance_health"))


#: Weights of the readiness score's parts.
READINESS = {"data_quality": 0.10, "split_safety": 0.20, "leakage_safety": 0.20, "data_sufficiency": 0.15, "balance_health": 0.10, "documentation": 0.10, "split_consistency": 0.15}
#: A part under its bound blocks training, or warns.
BLOCKERS, WARNINGS = {"split_safety": 30, "leakage_safety": 30, "data_sufficiency": 30}, {"balance_health": 40, "data_quality": 50, "documentation": 50}


@dataclass(frozen=True)
class Readiness:
    score: float
    grade: str
    ready: bool
    blockers: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def readiness(parts: dict[str, float]) -> Readiness:
    """Weighted score of parts from 0 to 100, its grade from A to F, what blocks training and what warns."""
    score = sum(w * parts[k] for k, w in READINESS.items())
    grade = next(n for b, n in ((90, "A"), (75, "B"), (60, "C"), (40, "D"), (-math.inf, "F")) if score >= b)
    under = lambda bounds: [k for k, b in bounds.items() if parts[k] < b]
    return Readiness(score, grade, not under(BLOCKERS) and score >= 60, under(BLOCKERS), under(WARNINGS))


def split_safety(severity: str) -> float:
    return {"critical": 0.0, "high": 20.0, "low": 60.0}.get(severity, 100.0)


def leakage_safety(risks: Sequence[str]) -> float:
    return 10.0 if {"high", "critical"} & set(risks) else 60.0 if risks else 100.0


def collinear_groups(pairs: Sequence[tuple[str, str, float]], least: float = 0.85) -> list[tuple[list[str], float, str]]:
    """(columns, mean absolute correlation of the pairs within, the column to keep) of linked columns. pairs: (a, b, r);
    links need `least`, the mean counts all given pairs. A table's columns are few."""
    group: dict[str, set[str]] = {}
    for a, b, r in pairs:
        if abs(r) > least:
            own = group.get(a, {a}) | group.get(b, {b})
            group.update(dict.fromkeys(own, own))
    out = []
    for own in {id(g): g for g in group.values()}.values():
        inner = [abs(r) for a, b, r in pairs if a in own and b in own]
        out.append((sorted(own), sum(inner) / len(inner), min(own)))
    return sorted(out)


def overall_severity(severities: Sequence[str], removed_columns: bool = False) -> str:
    """The worst of them; a removed column is critical."""
    order = ("none", "low", "medium", "high", "critical")
    return "critical" if removed_columns else max(severities, key=order.index, default="none")
