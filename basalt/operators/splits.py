"""Splits, folds, samplers, shards and batches. Order comes from a hash of the row's key, so a result does not depend
on how rows lie in partitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, uniform
from ..functions.names import free
from ..functions.text import let
from ..storage import written
from .skew import skew_join

#: What workers report of a shard, in the order of its life.
SHARD_LIFE = ("claimed", "processing", "failed", "completed")


def indexed(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """df with each row's place in the order, from 0.

    Rows are sorted by range and written with their range and their place in it; what comes before a range comes from counts
    of the ranges, one row a range, so no task sees all rows. Both are read from what was written: ranges that are made
    again have other bounds, since those come from a sample and the sizes of the columns that a plan reads.
    """
    part, nth, skipped = free(df, "part", "nth", "skipped")
    kept = [c for c in df.columns if c != name or c in order]
    void = [c for c, kind in df.dtypes if kind == "void" and c in kept]  # which Parquet does not hold
    ranged = df.select(*kept).repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = written(ranged.drop(*void)).withColumns({c: F.lit(None) for c in void})
    sizes = held.groupBy(part).count()
    before = sizes.select(part, F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(skipped))
    return held.join(F.broadcast(before), part).select(*(c for c in df.columns if c != name), (F.col(skipped) + F.col(nth)).alias(name))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, within the group of these columns.

    All rows are placed at once, groups one after the other, and the rows before a group, from the groups' counts, are
    taken off: a group that holds a third of all rows lies in many tasks.
    """
    group, first = free(df, "group", "first")
    placed = indexed(df.withColumn(group, F.to_json(F.struct(*by))), [group, *order], name)
    sizes = placed.groupBy(group).count()
    starts = sizes.select(group, F.coalesce(F.sum("count").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(first))
    return skew_join(placed, starts, [group], counts=sizes, rows=placed.count()).select(*(c for c in df.columns if c != name), (F.col(name) - F.col(first)).alias(name))


def hash_rank(df: DataFrame, key: str, seed: str = "42", name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """df with each row's place in hash order, from 0; by: within these columns' groups."""
    (h,) = free(df, "hash")
    hashed = df.withColumn(h, hash_key(seed, F.col(key)))
    return (ranked(hashed, by, [h, key], name) if by else indexed(hashed, [h, key], name)).drop(h)


def _cut(rank: Column, n: Column, ratios: Sequence[float]) -> Column:
    """train, val, test: floor cuts of the first two ratios, the rest test."""
    first, second = F.floor(n * F.lit(float(ratios[0]))), F.floor(n * F.lit(float(ratios[1])))
    return F.when(rank < first, "train").when(rank < first + second, "val").otherwise("test")


def _split(df: DataFrame, place: Callable[[str], DataFrame], n: Column, ratios: Sequence[float]) -> DataFrame:
    (r,) = free(df, "place")
    return place(r).select(*df.columns, _cut(F.col(r), n, ratios).alias("split"))


def validate_ratios(ratios: Sequence[float]) -> None:
    if len(ratios) != 3 or min(ratios) <= 0 or abs(sum(ratios) - 1) > 0.01:
        raise ValueError("three positive ratios that add up to 1")


def random_split(df: DataFrame, key: str, ratios: Sequence[float] = (0.6, 0.2, 0.2), seed: str = "42") -> DataFrame:
    """Adds split."""
    validate_ratios(ratios)
    n = df.count()
    return _split(df, lambda r: hash_rank(df, key, seed, r), F.lit(n), ratios)


def temporal_split(df: DataFrame, order: Sequence[str], ratios: Sequence[float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Adds split: the first rows train, the last ones test."""
    validate_ratios(ratios)
    n = df.count()
    return _split(df, lambda r: indexed(df, order, r), F.lit(n), ratios)


def stratified_split(df: DataFrame, key: str, stratum: str, ratios: Sequence[float] = (0.6, 0.2, 0.2), seed: str = "42") -> DataFrame:
    """Adds split, cut within each stratum."""
    validate_ratios(ratios)
    n, r, k = free(df, "size", "place", "key")
    sizes = df.groupBy(F.to_json(F.struct(stratum)).alias(k)).count().withColumnRenamed("count", n)
    placed = hash_rank(df, key, seed, r, [stratum]).withColumn(k, F.to_json(F.struct(stratum)))
    joined = skew_join(placed, sizes, [k], counts=sizes.withColumnRenamed(n, "count"), rows=df.count())
    return joined.select(*df.columns, _cut(F.col(r), F.col(n), ratios).alias("split"))


def group_split(df: DataFrame, group: str, ratios: Sequence[float] = (0.6, 0.2, 0.2), seed: str = "42") -> DataFrame:
    """Adds split; a group's rows stay together, groups are cut."""
    groups = df.select(group).distinct()
    return df.join(random_split(groups, group, ratios, seed), group)


def kfold(df: DataFrame, key: str, k: int = 5, seed: str = "42", remainder: str = "first") -> DataFrame:
    """Adds fold. remainder: "first" makes the first n % k folds one larger, "last" gives all of it to the last fold."""
    n, (at,) = df.count(), free(df, "place")
    placed, size, more = hash_rank(df, key, seed, at), n // k, n % k
    r = F.col(at)
    if remainder == "last":
        fold = F.least(F.floor(r / F.lit(max(size, 1))), F.lit(k - 1))
    else:
        head = more * (size + 1)
        fold = F.when(r < head, F.floor(r / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((r - head) / F.lit(max(size, 1))))
    return placed.select(*df.columns, fold.cast("int").alias("fold"))


def stratified_kfold(df: DataFrame, key: str, stratum: str, k: int = 5, seed: str = "42") -> DataFrame:
    (at,) = free(df, "place")
    return hash_rank(df, key, seed, at, [stratum]).select(*df.columns, (F.col(at) % k).cast("int").alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: str = "42") -> DataFrame:
    groups = df.select(group).distinct()
    size = max(groups.count() // k, 1)
    (at,) = free(groups, "place")
    folds = hash_rank(groups, group, seed, at).select(group, F.least(F.floor(F.col(at) / size), F.lit(k - 1)).cast("int").alias("fold"))
    return df.join(folds, group)


def fold_summary(folds: DataFrame) -> DataFrame:
    """folds, mean, variance of the fold sizes, and whether they are balanced: (max - min) / mean under 0.1."""
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("folds"), F.avg("n").alias("mean"), F.var_pop("n").alias("variance"), ((F.max("n") - F.min("n")) / F.avg("n") < 0.1).alias("balanced"))


def distributed_sample(df: DataFrame, order: Sequence[str], replicas: int, drop_last: bool = False) -> DataFrame:
    """Adds replica: contiguous ranges, the remainder one row each to the first replicas, or dropped."""
    n = df.count()
    size, more = n // replicas, 0 if drop_last else n % replicas
    rows, i = indexed(df, order, "_i"), F.col("_i")
    head = more * (size + 1)
    replica = F.when(i < head, F.floor(i / F.lit(size + 1))).otherwise(F.lit(more) + F.floor((i - head) / F.lit(max(size, 1))))
    return rows.filter(i < head + (replicas - more) * size).withColumn("replica", replica.cast("int")).drop("_i")


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: str = "42") -> DataFrame:
    """n rows without replacement, by the smallest -ln(u) / weight; rows without weight never come."""
    return df.filter(F.col(weight) > 0).withColumn("_k", -F.log(F.greatest(uniform(seed, F.col(key)), F.lit(1e-18))) / F.col(weight)).orderBy("_k", key).limit(n).drop("_k")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: str = "42", buckets: int = 10_000) -> DataFrame:
    """n draws with replacement: (draw, key). A row owns a range of the summed weights, in key order; ranges and draws meet in
    buckets of equal width, at most `buckets` more of them than rows.

    Sums are taken within sorted partitions; the partitions' totals, one row each, give where each starts.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")).filter("w > 0")
    held = written(rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    sums = held.groupBy("part").agg(F.sum("w").alias("sum"))
    total = sums.agg(F.sum("sum")).first()[0]
    if not total:
        return spark.range(0).select(F.col("id").alias("draw")).crossJoin(df.select(key).limit(0))
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    hi = F.col("before") + F.sum("w").over(Window.partitionBy("part").orderBy("key"))
    upto = held.join(F.broadcast(before), "part").select("key", hi.alias("hi"), (hi - F.col("w")).alias("lo"))
    width = total / max(1, min(n, buckets))
    spans = upto.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    draws = spark.range(n).select(F.col("id").alias("draw"), (uniform(seed, F.col("id")) * total).alias("u")).withColumn("bucket", F.floor(F.col("u") / width))
    return draws.join(spans, "bucket").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", F.col("key").alias(key))


def subset_sample(df: DataFrame, order: Sequence[str], indices: DataFrame, seed: str = "42") -> DataFrame:
    """The rows at these indices (a column index), in hash order. Adds place."""
    (i,) = free(df, "index")
    chosen = indexed(df, order, i).join(indices.select(F.col("index").alias(i)).distinct(), i, "left_semi")
    return hash_rank(chosen, i, seed, "place").drop(i)


def accessor_sample(df: DataFrame, order: Sequence[str], n: int, mode: str = "first", key: str | None = None, seed: str = "42") -> DataFrame:
    """n rows: the first ones of the order; random ones, by hash; or, as the operator defines it, stratified as the first."""
    if mode == "random":
        return weighted_sample(df.withColumn("weight", F.lit(1.0)), key or order[0], "weight", n, seed).drop("weight")
    return df.orderBy(*order).limit(n)


def shard_sizes(rows: int, k: int, shard: int | None = None) -> list[int]:
    """Rows of each contiguous shard; k must be positive and a shard's number under it."""
    if k < 1 or (shard is not None and not 0 <= shard < k):
        raise ValueError("k: positive; shard: from 0 to k - 1")
    return [rows // k + (i < rows % k) for i in range(k)]


def streamed_shuffle(df: DataFrame, order: Sequence[str], key: str, k: int, buffer: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Adds shard and place: shards are read in order, and each buffer of rows leaves in this epoch's hash order."""
    i, at = free(df, "index", "at")
    placed = ranked(shards(df, order, k), ["shard"], order, i).withColumn(at, F.floor(F.col(i) / buffer))
    return ranked(placed.withColumn("h", hash_key(f"{seed + epoch}", F.col(key))), ["shard"], [at, "h", key], "place").select(*df.columns, "shard", "place")


def batch_stats(batches: DataFrame, batch: str = "batch", ids: str = "input_ids") -> DataFrame:
    """(batch, samples, tokens, max_length, padding_ratio): the share of a batch's cells that padding to its longest row fills."""
    n = F.size(ids)
    got = batches.groupBy(batch).agg(F.count("*").alias("samples"), F.sum(n).alias("tokens"), F.max(n).alias("max_length"))
    cells = F.col("samples") * F.col("max_length")
    return got.withColumn("padding_ratio", F.when(cells > 0, 1 - F.col("tokens") / cells).otherwise(0.0))


def collation_report(collated: DataFrame, mask: str = "mask") -> DataFrame:
    """One row of collated batches: samples, cells, tokens under the mask, padding ratio and efficiency."""
    got = collated.agg(F.count("*").alias("samples"), F.sum(F.size(mask)).alias("cells"), F.sum(F.aggregate(mask, F.lit(0), lambda a, x: a + x)).alias("tokens"))
    padding = F.when(F.col("cells") > 0, 1 - F.col("tokens") / F.col("cells")).otherwise(0.0)
    return got.withColumn("padding_ratio", padding).withColumn("efficiency", 1 - padding)


def batches(df: DataFrame, order: Sequence[str], size: int, drop_last: bool = False) -> DataFrame:
    """Adds batch, from 0."""
    rows = indexed(df, order, "_i").withColumn("batch", F.floor(F.col("_i") / size))
    if drop_last:
        rows = rows.filter(F.col("batch") < df.count() // size)
    return rows.drop("_i")


def shards(df: DataFrame, order: Sequence[str], k: int, mode: str = "contiguous", key: str | None = None) -> DataFrame:
    """Adds shard: contiguous (the first n % k shards one larger), interleaved (index modulo k) or hashed (key modulo k)."""
    if mode == "hashed":
        return df.withColumn("shard", F.pmod(hash_key("shard", F.col(key or order[0])), F.lit(k)).cast("int"))
    rows = indexed(df, order, "_i")
    if mode == "interleaved":
        return rows.withColumn("shard", (F.col("_i") % k).cast("int")).drop("_i")
    return distributed_sample(df, order, k).withColumnRenamed("replica", "shard")


def shuffled_shards(df: DataFrame, order: Sequence[str], key: str, k: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Adds shard and its rows' places in this epoch's order."""
    return hash_rank(shards(df, order, k), key, f"{seed + epoch}", "place", ["shard"])


def shard_states(shards: DataFrame, events: DataFrame, heartbeats: DataFrame, now: float, timeout: float = 300.0) -> DataFrame:
    """(shard_id, state, worker): what workers did last with each shard.

    events: (shard_id, worker, event, at) with claimed, processing, completed or failed; heartbeats: (worker, at). Shards
    without an event are available; so are those in the hands of a worker whose last heartbeat is older than the timeout.
    Workers without a heartbeat keep theirs. Of events at the same time the later in the order of a shard's life counts.
    """
    life = F.array_position(F.array(*map(F.lit, SHARD_LIFE)), F.col("event"))
    last = events.groupBy("shard_id").agg(F.max(F.struct("at", life.alias("life"), "event", "worker")).alias("last"))
    beats = heartbeats.groupBy("worker").agg(F.max("at").alias("beat"))
    known = shards.select("shard_id").distinct().join(last, "shard_id", "left").select("shard_id", "last.event", "last.worker").join(beats, "worker", "left")
    gone = F.col("event").isNull() | (F.col("event").isin(*SHARD_LIFE[:2]) & F.coalesce(F.lit(float(now)) - F.col("beat") > timeout, F.lit(False)))
    return known.select("shard_id", F.when(gone, "available").otherwise(F.col("event")).alias("state"), F.when(~gone, F.col("worker")).alias("worker"))


def shard_progress(states: DataFrame) -> DataFrame:
    """One row: total, completed, in_progress, failed, available, completion_pct (0 without shards)."""
    of = lambda *s: F.count_if(F.col("state").isin(*s))
    got = states.agg(F.count("*").alias("total"), of("completed").alias("completed"), of(*SHARD_LIFE[:2]).alias("in_progress"), of("failed").alias("failed"), of("available").alias("available"))
    return got.withColumn("completion_pct", F.coalesce(F.try_divide(100.0 * F.col("completed"), F.col("total")), F.lit(0.0)))


def bottleneck(load: float, tokenize: float, collate: float) -> tuple[str, float]:
    """The slowest step of a loader, the later of equals, and tokenization's share of the time."""
    total = load + tokenize + collate
    slowest = "data_loading" if load > max(tokenize, collate) else "tokenization" if tokenize > collate else "collation"
    return slowest, tokenize / total if total > 0 else 0.0


def shard_of(manifest: DataFrame, indices: DataFrame) -> DataFrame:
    """(index, shard_id, local): manifest has shard_id and num_samples, indices has index."""
    m = manifest.withColumn("_hi", F.sum("num_samples").over(Window.orderBy("shard_id"))).withColumn("_lo", F.col("_hi") - F.col("num_samples"))
    return indices.join(m, (F.col("index") >= F.col("_lo")) & (F.col("index") < F.col("_hi"))).select("index", "shard_id", (F.col("index") - F.col("_lo")).alias("local"))


def dynamic_batches(df: DataFrame, key: str, length: str, buckets: Sequence[int] = (64, 128, 256, 512), max_tokens: int = 4096) -> DataFrame:
    """Adds bucket (the smallest bound that holds the row) and batch within it: up to 1.25 * max_tokens / bucket rows."""
    bucket = F.lit(buckets[-1])
    for b in reversed(buckets):
        bucket = F.when(F.col(length) <= b, b).otherwise(bucket)
    place, most = free(df, "place", "most")
    cap = F.greatest(F.floor(F.lit(max_tokens) / F.col("bucket") * 1.25), F.lit(1))
    rows = ranked(df.withColumn("bucket", bucket), ["bucket"], [length, key], place).withColumn(most, cap)
    return rows.select(*df.columns, "bucket", F.floor(F.col(place) / F.col(most)).alias("batch"))


def collate(df: DataFrame, batch: str, ids: str, pad: int = 0, multiple: int = 8) -> DataFrame:
    """Adds padded ids and mask, as long as the batch's longest row, rounded up."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    target = (F.ceil(longest / F.lit(multiple)) * multiple).cast("int")
    n = F.greatest(target - F.size(ids), F.lit(0))
    return df.withColumn("_n", n).withColumn("mask", F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), F.col("_n")))).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("_n")))).drop("_n")


def collate_pairs(df: DataFrame, batch: str, source: str, target: str, pad: int = 0, ignore: int = -100, multiple: int = 8) -> DataFrame:
    """Sources and targets padded each to its batch's longest; targets with `ignore`. Adds mask of the sources."""
    longest = F.max(F.size(target)).over(Window.partitionBy(batch))
    n = F.greatest((F.ceil(longest / F.lit(multiple)) * multiple).cast("int") - F.size(target), F.lit(0))
    padded = df.withColumn("_n", n).withColumn(target, F.concat(target, F.array_repeat(F.lit(ignore), F.col("_n")))).drop("_n")
    return collate(padded, batch, source, pad, multiple)


def mask_tokens(ids: Column, key: Column, vocabulary: int, mask_id: int, share: float = 0.15, special: Sequence[int] = (), seed: str = "42") -> Column:
    """struct<ids, labels>: ceil(share) of the other tokens chosen by hash; 80 % become mask_id, 10 % a random id; labels
    are -100 elsewhere."""

    def bound(ids: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: ~F.get(ids, i).isin(list(special)) if special else F.lit(True))
        chosen = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(hash_key(seed, F.concat_ws("|", key.cast("string"), i.cast("string"))).alias("h"), i.alias("i")))), 1, F.ceil(F.size(places) * share).cast("int"))

        def masked(at: Column) -> Column:
            def new(x: Column, i: Column) -> Column:
                h = hash_key(seed + "r", F.concat_ws("|", key.cast("string"), i.cast("string")))
                return F.when(~F.array_contains(at, i), x).when(h % 10 < 8, F.lit(mask_id)).when(h % 10 == 8, (F.floor(h / 10) % vocabulary).cast("int")).otherwise(x)

            empty = F.size(ids) == 0
            return F.struct(F.when(empty, ids).otherwise(F.transform(ids, new)).alias("ids"), F.when(empty, ids).otherwise(F.transform(ids, lambda x, i: F.when(F.array_contains(at, i), x).otherwise(F.lit(-100)))).alias("labels"))

        return let(F.transform(chosen, lambda x: x["i"]), masked)

    return let(ids, bound)
