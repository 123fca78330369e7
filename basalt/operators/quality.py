"""Corpus statistics, curation reports, quality scores, expectations and gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def curate(df: DataFrame, text: str, toxicity: float = 0.7, chars: tuple[int, int] = (10, 1_000_000), words: tuple[int, int] = (3, 100_000)) -> DataFrame:
    """df with pii, toxicity, lang, confidence, score, issues, length_ok and passed, all in one projection."""
    t = F.coalesce(F.col(text), F.lit(""))
    got = df.withColumns({"pii": X.detect_pii(t), "toxicity": X.toxicity_score(t), "_l": X.detect_language(t), "_q": X.quality(t), "length_ok": F.length(t).between(*chars) & F.size(X.words(t)).between(*words)})
    return got.select(*df.columns, "pii", "toxicity", F.col("_l.lang").alias("detected_lang"), F.col("_l.confidence").alias("confidence"), F.col("_q.score").alias("score"), F.col("_q.issues").alias("issues"), "length_ok", (F.col("_q.passed") & F.col("length_ok") & (F.col("toxicity") <= toxicity) & (F.size("pii") == 0)).alias("passed"))


def curation_report(curated: DataFrame, toxicity: float = 0.7) -> DataFrame:
    """Counters, which may overlap, and the pass rate."""
    n = F.count(F.lit(1))
    return curated.agg(n.alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.size("pii") > 0).alias("with_pii"), F.count_if(F.col("toxicity") > toxicity).alias("toxic"), F.count_if(F.size("issues") > 0).alias("low_quality"), F.count_if(~F.col("length_ok")).alias("bad_length"), F.when(n > 0, F.count_if("passed") / n).otherwise(0.0).alias("pass_rate"))


#: Bounds of the length buckets, in characters, and of the token buckets.
LENGTHS, TOKENS = (10, 100, 500, 2000), (10, 50, 200, 1000)


def bucket_of(x: Column, bounds: Sequence[float]) -> Column:
    """The number of bounds that are at most x."""
    return reduce(lambda a, b: a + b, ((x >= b).cast("int") for b in bounds))


def length_stats(df: DataFrame, text: str) -> DataFrame:
    """Minimum, maximum, mean and upper median of characters and words, and documents by length bucket."""
    own = df.select(F.length(text).alias("c"), F.size(X.words(F.col(text))).alias("w"), bucket_of(F.length(text), LENGTHS).alias("b"))
    n = own.count()
    p = min(n // 2, n - 1) / (n - 1) if n > 1 else 0.0
    aggs = [f(c).alias(f"{name}_{long}") for c, long in (("c", "chars"), ("w", "words")) for name, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("median", lambda x: F.percentile(x, F.lit(p))))]
    return own.agg(*aggs, *(F.count_if(F.col("b") == i).alias(f"bucket_{i}") for i in range(len(LENGTHS) + 1)))


def token_stats(df: DataFrame, text: str) -> DataFrame:
    """Tokens in all, distinct ones, mean a document, and documents by token bucket."""
    own = df.select(X.words(F.col(text)).alias("w")).withColumn("b", bucket_of(F.size("w"), TOKENS))
    distinct = own.select(F.explode("w").alias("t")).agg(F.count_distinct("t").alias("distinct_tokens"))
    return own.agg(F.sum(F.size("w")).alias("tokens"), F.avg(F.size("w")).alias("mean_tokens"), *(F.count_if(F.col("b") == i).alias(f"bucket_{i}") for i in range(len(TOKENS) + 1))).crossJoin(distinct)


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Words (lower-case, trimmed of what is not a letter or digit), distinct ones, once-only ones, type-token ratio."""
    w = F.explode(X.words(F.lower(text)))
    trimmed = df.select(w.alias("w")).select(F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("w")).filter("w <> ''")
    counts = trimmed.groupBy("w").count()
    return counts.agg(F.sum("count").alias("words"), F.count("*").alias("vocabulary"), F.count_if(F.col("count") == 1).alias("hapax"), (F.count("*") / F.sum("count")).alias("type_token_ratio"))


def ngram_diversity(df: DataFrame, text: str) -> DataFrame:
    """Distinct over all word bigrams and trigrams, and the share of trigrams that come more than 3 times."""
    out = None
    for n in (2, 3):
        counts = df.select(F.explode(X.word_ngrams(X.words(F.lower(text)), n)).alias("g")).groupBy("g").count()
        own = counts.agg((F.count("*") / F.sum("count")).alias(f"distinct_{n}"), (F.sum(F.when(F.col("count") > 3, F.col("count")).otherwise(0)) / F.sum("count")).alias(f"repeated_{n}"))
        out = own if out is None else out.crossJoin(own)
    return out


def text_issues(df: DataFrame, text: str) -> DataFrame:
    """(issue, n, severity, share) of a corpus: empty texts; texts under 5 characters, if over 5 % are; mostly special
    characters; texts over 2000 characters, if the mean is."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.count(F.lit(1))
    size, blank = F.length(t), F.regexp_replace(t, r"\s", "") == ""
    special = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    row = lambda issue, severity, k, keep: F.when((k > 0) & keep, F.struct(F.lit(issue).alias("issue"), k.alias("n"), F.lit(severity).alias("severity"), (k / n).alias("share")))
    short, yes = F.count_if(~blank & (size < 5)), F.lit(True)
    found = F.array(row("empty_texts", "high", F.count_if(blank), yes), row("very_short_texts", "medium", short, short / n > 0.05), row("special_char_heavy", "low", F.count_if((size > 0) & (special / size > 0.5)), yes), row("very_long_texts", "medium", F.count_if(size > 2000), F.avg(size) > 2000))
    return df.agg(F.array_compact(found).alias("l")).select(F.explode("l").alias("x")).select("x.*")


def corpus_score(issues: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row, score from 0 to 1: 1, less the issues' shares by severity, plus a bonus for a rich vocabulary."""
    weight = F.when(F.col("severity") == "high", 0.15).when(F.col("severity") == "medium", 0.08).otherwise(0.03)
    penalty = issues.agg(F.coalesce(F.sum(F.col("share") * weight), F.lit(0.0)).alias("penalty"))
    ratio = F.col("type_token_ratio")
    bonus = F.when(ratio > 0.1, 0.05).when(ratio > 0.05, 0.02).otherwise(0.0)
    return vocabulary.crossJoin(F.broadcast(penalty)).select(F.least(F.greatest(1 - F.col("penalty") + bonus, F.lit(0.0)), F.lit(1.0)).alias("score"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("critical")


#: Weights of the parts of a dataset's score.
PARTS = {"completeness": 0.35, "consistency": 0.25, "information": 0.25, "balance": 0.15}


def dataset_score(profiles: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """Score of a table from its column profiles; tops: (column, top), the count of each column's most frequent value."""
    p = profiles if tops is None else profiles.join(tops, "column", "left")
    share = F.when(F.col("total") > 0, F.col("distinct") / F.col("total")).otherwise(0.0)
    information = F.when(F.col("distinct") <= 1, 20.0).when(share > 0.95, 50.0).when(share > 0.5, 95.0).otherwise(75 + 20 * share)
    balance = F.lit(0.0)
    if tops is not None:
        rate = F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(0.0)
        balance = F.when((rate > 0.9) & (F.col("total") > 50), 20.0).when(rate > 0.7, 10.0).otherwise(0.0)
    got = p.agg(
        ((1 - F.sum("nulls") / F.greatest(F.sum("total"), F.lit(1))) * 100).alias("completeness"),
        (100 - 100 * F.count_if(F.col("distinct") == 0) / F.count("*")).alias("consistency"),
        F.avg(information).alias("information"),
        F.greatest(100 - F.sum(balance), F.lit(0.0)).alias("balance"),
    )
    total = reduce(lambda a, b: a + b, (F.col(k) * w for k, w in PARTS.items()))
    return got.withColumn("score", total).withColumn("grade", grade(total))


@dataclass(frozen=True)
class Expectation:
    """kind: not_null, unique, in_range (low, high), in_set (values), row_count (low, high), type_match (values: one type name),
    no_duplicate_columns, schema_match (values: the column names)."""

    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    severity: str = "error"


def check(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """(expectation, column, severity, failures, passed): all in one pass over df."""
    aggs = []
    for e in expectations:
        c = F.col(e.column) if e.column else F.lit(None)
        out = {
            "not_null": lambda c=c: F.count_if(c.isNull()),
            "unique": lambda c=c: F.count(c) - F.count_distinct(c),
            "in_range": lambda c=c, e=e: F.count_if((c < e.low) | (c > e.high)),
            "in_set": lambda c=c, e=e: F.count_if(c.isNotNull() & ~c.isin(list(e.values))),
            "row_count": lambda e=e: F.when(F.count(F.lit(1)).between(e.low, e.high), 0).otherwise(1),
            "type_match": lambda e=e: F.max(F.lit(int(df.schema[e.column].dataType.simpleString() not in e.values))),
            "no_duplicate_columns": lambda: F.max(F.lit(len(df.columns) - len({x.lower() for x in df.columns}))),
            "schema_match": lambda e=e: F.max(F.lit(len(set(df.columns) ^ set(e.values)))),
        }[e.kind]()
        aggs.append(F.struct(F.lit(e.kind).alias("expectation"), F.lit(e.column or "").alias("column"), F.lit(e.severity).alias("severity"), F.coalesce(out.cast("long"), F.lit(0)).alias("failures")).alias(f"_{len(aggs)}"))
    return df.agg(*aggs).select(F.explode(F.array(*(f"_{i}" for i in range(len(aggs))))).alias("e")).select("e.*", (F.col("e.failures") == 0).alias("passed"))


def expectation_report(results: DataFrame) -> DataFrame:
    """Counts of passed and failed ones by severity; ok without a failed error."""
    failed = ~F.col("passed")
    return results.agg(F.count_if("passed").alias("passed"), *(F.count_if(failed & (F.col("severity") == s)).alias(f"failed_{s}") for s in ("error", "warning", "info")), (F.count_if(failed & (F.col("severity") == "error")) == 0).alias("ok"))


def suggested(profiles: DataFrame) -> list[Expectation]:
    """Expectations from column profiles: a row count, not null where nothing is, ranges 10 % wider, uniqueness."""
    out = [Expectation("row_count", None, 1, 10_000_000)]
    for r in profiles.orderBy("column").collect():
        out += [Expectation("not_null", r["column"])] * (r["nulls"] == 0)
        if r["min"] is not None:
            more = abs(r["max"] - r["min"]) * 0.1
            out.append(Expectation("in_range", r["column"], r["min"] - more, r["max"] + more, severity="warning"))
        out += [Expectation("unique", r["column"], severity="info")] * (r["distinct"] == r["total"] > 0)
    return out


def gate(value: Column, least: float | None = None, most: float | None = None, action: str = "warn") -> Column:
    """struct<passed, action>: action if the value is outside its bounds, else continue."""
    ok = (value >= F.lit(least) if least is not None else F.lit(True)) & (value <= F.lit(most) if most is not None else F.lit(True))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("passed"), F.when(ok, "continue").otherwise(action).alias("action"))


def dashboard(snapshots: DataFrame) -> DataFrame:
    """snapshots: (dataset, at, score). The latest of each, its level (0.9, 0.7, 0.5), rank, and change from the one before."""
    w = Window.partitionBy("dataset").orderBy("at")
    last = snapshots.withColumn("trend", F.col("score") - F.lag("score").over(w)).withColumn("_n", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("at")))).filter("_n = 1").drop("_n")
    level = F.when(F.col("score") >= 0.9, "excellent").when(F.col("score") >= 0.7, "good").when(F.col("score") >= 0.5, "fair").otherwise("poor")
    return last.withColumn("level", level).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "dataset")))


def dashboard_summary(latest: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: datasets, their mean score, how many stand at each level, and the share of issues (dataset, resolved) that are
    resolved."""
    resolved = issues.agg(F.coalesce(F.avg(F.col("resolved").cast("double")), F.lit(0.0)).alias("resolution_rate"))
    levels = [F.count_if(F.col("level") == n).alias(n) for n in ("excellent", "good", "fair", "poor")]
    return latest.agg(F.count("*").alias("datasets"), F.avg("score").alias("mean_score"), *levels).crossJoin(F.broadcast(resolved))


def image_stats(images: DataFrame) -> DataFrame:
    """images: (path, width, height, format, file_size). Means, pixel and aspect buckets, zero-size files, score."""
    pixels, aspect, n = F.col("width") * F.col("height"), F.col("width") / F.col("height"), F.count(F.lit(1))
    p, a = bucket_of(pixels, (10_000, 100_000, 1_000_000, 4_000_000)), bucket_of(aspect, (0.8, 1.2, 1.8))
    variation = F.stddev_pop("width") / F.avg("width")
    zero = F.count_if(F.col("file_size") == 0)
    return images.agg(n.alias("images"), F.avg("width").alias("mean_width"), F.avg("height").alias("mean_height"), *(F.count_if(p == i).alias(f"pixels_{i}") for i in range(5)), *(F.count_if(a == i).alias(f"aspect_{i}") for i in range(4)), zero.alias("zero_size"), variation.alias("width_variation"), F.greatest(1 - zero / n * 0.15 - F.when(variation > 0.5, 0.08).otherwise(0.0), F.lit(0.0)).alias("score"))


def monitor(batches: DataFrame, ids: str = "input_ids", label: str | None = "label", most: int = 512) -> DataFrame:
    """Samples, tokens, mean, median, 95th percentile and largest length, share truncated, label entropy in bits and imbalance."""
    n = F.size(ids)
    out = batches.agg(F.count("*").alias("samples"), F.sum(n).alias("tokens"), F.avg(n).alias("mean_length"), F.percentile(n, F.lit(0.5)).alias("median_length"), F.percentile(n, F.lit(0.95)).alias("p95_length"), F.max(n).alias("max_length"), (F.count_if(n > most) / F.count("*")).alias("truncated"))
    if label is None:
        return out
    counts = batches.filter(F.col(label).isNotNull()).groupBy(label).count()
    total = counts.agg(F.sum("count").alias("_t"))
    p = F.col("count") / F.col("_t")
    return out.crossJoin(counts.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("label_entropy"), (F.max("count") / F.min("count")).alias("label_imbalance")))


def token_monitor(batches: DataFrame, ids: str = "input_ids", pad: int = 0, unknown: int = 1) -> DataFrame:
    """One row: the shares of padding and of unknown tokens among all, and of empty sequences."""
    of = lambda x: F.sum(F.size(F.filter(ids, lambda i: i == x)))
    n = F.greatest(F.sum(F.size(ids)), F.lit(1))
    return batches.agg((of(pad) / n).alias("padding"), (of(unknown) / n).alias("oov"), (F.count_if(F.size(ids) == 0) / F.greatest(F.count("*"), F.lit(1))).alias("empty"))


def token_alerts(stats: DataFrame, empty: float = 0.05, oov: float = 0.05) -> DataFrame:
    """The names of the thresholds that a token monitor row breaks."""
    return stats.select(F.array_compact(F.array(F.when(F.col("empty") > empty, F.lit("empty")), F.when(F.col("oov") > oov, F.lit("oov")))).alias("alerts"))


def alerts(stats: DataFrame, truncated: float = 0.1, imbalance: float = 10.0) -> DataFrame:
    """The names of the thresholds that a monitor row breaks."""
    return stats.select(F.array_compact(F.array(F.when(F.col("samples") == 0, F.lit("empty")), F.when(F.col("truncated") > truncated, F.lit("truncation")), F.when(F.col("label_imbalance") > imbalance, F.lit("imbalance")))).alias("alerts"))
