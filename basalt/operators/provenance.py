"""Where rows come from and what their licences allow.

rows: (row_index, source_type, source_name, license, consent, commercial, attribution, restrictions): restrictions is an
array of names, the flags are boolean; NULL is unknown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How grave a restriction is; others are medium.
GRAVE = {"no_commercial_use": "high", "export_control": "high", "confidentiality": "critical", "data_subject_rights": "critical"}


def distribution(rows: DataFrame) -> DataFrame:
    """(kind, value, n) of source types and licences."""
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), name(c).alias("value")) for k, c in (("source", "source_type"), ("license", "license"))))
    return rows.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def restrictions(rows: DataFrame) -> DataFrame:
    """(restriction, n, share, severity)."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode("restrictions").alias("restriction")).groupBy("restriction").agg(F.count("*").alias("n"))
    grave = F.create_map(*(F.lit(x) for kv in GRAVE.items() for x in kv))
    return counts.crossJoin(F.broadcast(total)).select("restriction", "n", (F.col("n") / F.col("total")).alias("share"), F.coalesce(grave[F.col("restriction")], F.lit("medium")).alias("severity"))


def issues(rows: DataFrame) -> DataFrame:
    """One row: rows, rows with a known source, unknown licences, user content without consent, restrictions on commerce, and
    the compliance score: 1, less 0.2 for any unknown licence and 0.3 for any missing consent."""
    unknown = F.lower(F.coalesce("license", F.lit("unknown"))) == "unknown"
    missing = (F.col("source_type") == "user_generated") & ~F.coalesce("consent", F.lit(False))
    barred = F.coalesce(F.array_contains("restrictions", "no_commercial_use"), F.lit(False))
    got = rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("source_type", F.lit("unknown")) != "unknown").alias("with_source"), F.count_if(unknown).alias("unknown_license"), F.count_if(F.coalesce(missing, F.lit(False))).alias("missing_consent"), F.count_if(barred).alias("commercial_restriction"))
    return got.withColumn("score", 1.0 - F.when(F.col("unknown_license") > 0, 0.2).otherwise(0.0) - F.when(F.col("missing_consent") > 0, 0.3).otherwise(0.0))


def commercial_violations(rows: DataFrame) -> DataFrame:
    """(row_index, issue): licences that bar commerce, and restrictions that do."""
    found = F.array_compact(F.array(F.when(~F.coalesce("commercial", F.lit(False)), F.lit("license")), F.when(F.array_contains("restrictions", "no_commercial_use"), F.lit("restriction"))))
    return rows.select("row_index", F.explode(found).alias("issue"))


def allowed(rows: DataFrame, licenses: Sequence[str]) -> DataFrame:
    """The rows under one of these licences."""
    return rows.filter(F.col("license").isin(list(licenses)))


def attribution(rows: DataFrame) -> DataFrame:
    """One row, text: the distinct sources that ask for attribution, sorted."""
    names = rows.filter("attribution").select(F.concat("source_name", F.lit(" (via "), F.coalesce("source_type", F.lit("unknown")), F.lit(")")).alias("t")).distinct()
    joined = names.agg(F.array_join(F.array_sort(F.collect_list("t")), "; ").alias("text"))
    return joined.select(F.when(F.col("text") == "", "No attribution required").otherwise(F.col("text")).alias("text"))
