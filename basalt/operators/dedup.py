"""Exact and near duplicates of rows and texts, MinHash signatures, banding, keep-first resolution, components."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ..storage import dropped, shared_dir, written
from .skew import SHARE, skew_join

PRIME = 2147483647
try:  # the plain module is faster on short texts
    from _md5 import md5
except ImportError:
    md5 = hashlib.md5


def row_key(columns: Sequence[str], lower: bool = True, trim: bool = True) -> Column:
    """Cells lower-cased and trimmed, joined by |; NULL counts as empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    cells = [F.trim(c) if trim else c for c in cells]
    return F.concat_ws("|", *(F.lower(c) if lower else c for c in cells))


def exact_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, groups (of more than one), duplicates (rows beyond the first), rate, largest group."""
    groups = df.groupBy(F.md5(row_key(columns or df.columns)).alias("k")).agg(F.count("*").alias("n"))
    more = F.col("n") > 1
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(more).alias("groups"), F.coalesce(F.sum(F.when(more, F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.max(F.when(more, F.col("n"))), F.lit(0)).alias("largest")).withColumn("rate", F.when(F.col("rows") > 0, F.col("duplicates") / F.col("rows")).otherwise(0.0))


def exact_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Adds cluster, the smallest key with the same text, and is_duplicate. Texts meet by hash; equal hashes are compared.

    Keys are grouped before they are joined back, so a text that a third of the rows share is one row of the right side.
    """
    least = df.groupBy(F.sha2(F.col(text), 256).alias("_h")).agg(F.min(key).alias("cluster"))
    joined = df.withColumn("_h", F.sha2(F.col(text), 256)).join(least, "_h", "left").drop("_h")
    return joined.withColumn("cluster", F.coalesce("cluster", F.col(key))).withColumn("is_duplicate", F.col(key) != F.col("cluster"))


def dataset_digest(df: DataFrame) -> DataFrame:
    """One row, digest: independent of the rows' order. Row hashes are added up in 4 parts of 60 bits."""
    h = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    part = lambda i: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0)).cast("string") for i in range(4)]
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("digest"))


@lru_cache(maxsize=4)
def _coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    one = lambda kind, p: int(hashlib.md5(f"{kind}|{p}".encode()).hexdigest()[:8], 16)
    ps = range(permutations)
    return np.array([one("a", p) % (PRIME - 1) + 1 for p in ps], np.uint64)[:, None], np.array([one("b", p) % PRIME for p in ps], np.uint64)[:, None]


def signature(text: str, n: int, permutations: int) -> np.ndarray:
    """Minima of (a * h + b) mod a prime over the hashes h of the distinct character n-grams, a piece of the text at a time."""
    a, b = _coefficients(permutations)
    grams = {text[i : i + n] for i in range(len(text) - n + 1)}
    h = np.frombuffer(b"".join([md5(g.encode()).digest()[:4] for g in grams]), ">u4").astype(np.uint64) % np.uint64(PRIME)
    least = np.full(permutations, PRIME, np.uint32)
    for i in range(0, len(h), 512):
        x = a * h[i : i + 512]
        x += b  # under 2**62; 2**31 is 1 modulo the prime
        high = x >> np.uint64(31)
        x &= np.uint64(PRIME)
        x += high
        low = x.astype(np.uint32)  # at most twice the prime: a smaller value wraps beyond it when the prime is taken off
        for _ in range(2):
            np.minimum(low, low - np.uint32(PRIME), out=low)
        least = np.minimum(least, low.min(axis=1))
    return least.astype(np.int64)


def minhash(df: DataFrame, key: str, text: str, n: int = 5, permutations: int = 128, least_bytes: int = 50, most_bytes: int = 100_000) -> DataFrame:
    """(key, signature): array of `permutations` minima over the character n-grams.

    Texts outside the byte bounds, as the operator defines, have no signature. A document is signed where it lies, in one
    Arrow pass; no shingle becomes a row.
    """
    ship(df.sparkSession)

    @F.arrow_udf("array<bigint>")
    def signed(column: pa.Array) -> pa.Array:
        return pa.array([signature(t, n, permutations) for t in column.to_pylist()], pa.list_(pa.int64()))

    trimmed = df.select(key, F.trim(F.col(text)).alias("text")).filter(F.octet_length("text").between(least_bytes, most_bytes) & (F.length("text") >= n))
    return trimmed.select(key, signed.asNondeterministic()("text").alias("signature"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def bands(signatures: DataFrame, key: str, n_bands: int, rows: int) -> DataFrame:
    """(key, band, hash)."""
    parts = F.array(*(F.md5(F.concat(F.lit(f"{i}|"), F.array_join(F.transform(F.slice("signature", i * rows + 1, rows), lambda x: x.cast("string")), ","))) for i in range(n_bands)))
    return signatures.select(key, F.posexplode(parts).alias("band", "hash"))


def candidate_pairs(banded: DataFrame, key: str, star: bool = False) -> DataFrame:
    """(a, b), a < b: keys that share a band. star: each key with the smallest of its bucket only, linear in the rows."""
    if star:
        least = banded.groupBy("band", "hash").agg(F.min(key).alias("a"), F.count("*").alias("_n")).filter("_n > 1")
        return banded.join(least, ["band", "hash"]).filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b")).distinct()
    left, right = banded.select("band", "hash", F.col(key).alias("a")), banded.select("band", "hash", F.col(key).alias("b"))
    return left.join(right, ["band", "hash"]).filter("a < b").select("a", "b").distinct()


def band_threshold(n_bands: int, rows: int) -> float:
    """The similarity at which a pair becomes a likely candidate."""
    return (1 / n_bands) ** (1 / rows)


def similar_pairs(signatures: DataFrame, key: str, threshold: float = 0.8, n_bands: int = 16, rows: int = 8, block: int = 1000, forest: bool = False) -> DataFrame:
    """(a, b), a < b: keys of different signatures that share a band and agree in `threshold` of their places or more.

    Equal signatures stand for one, by their smallest key. A bucket of over `block` of them is searched block against
    block, so that no task holds more; forest: only a spanning forest of the links found in a block or two, which has the
    same components.
    """
    reps = signatures.groupBy("signature").agg(F.min(key).cast("long").alias("rep")).select("rep", "signature")
    reps = written(reps)
    banded = bands(reps, "rep", n_bands, rows)
    counts = banded.groupBy("band", "hash").count().filter("count > 1")
    sized = skew_join(banded, counts, ["band", "hash"], counts=counts, rows=reps.count() * n_bands)
    own, n = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"), F.ceil(F.col("count") / block).cast("int")
    dealt = sized.withColumn("n", n).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = dealt.select("band", "hash", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).alias("side"), "rep")

    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := list(it)) else None
        if table is None or not table.num_rows:
            return
        keys = [table.column(c).to_pylist() for c in ("band", "hash", "i", "j")]
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        signs = table.column("signature").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        groups: dict[tuple, list[int]] = defaultdict(list)
        for at, cell in enumerate(zip(*keys, strict=True)):
            groups[cell].append(at)
        for at in groups.values():
            at = np.array(sorted(at, key=lambda k: rep[k]))
            parent = np.arange(len(at))
            for k in range(len(at) - 1):
                later = at[k + 1 :]
                near = ((signs[later] == signs[at[k]]).sum(axis=1) >= threshold * signs.shape[1] - 1e-9) & ((side[later] == 0) | (side[later] != side[at[k]]))
                found = np.flatnonzero(near) + k + 1
                if forest:
                    found = np.array([f for f in found.tolist() if _united(parent, k, f)], np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rep[at[k]])), pa.array(rep[at[found]])], ["a", "b"])

    placed = cells.join(reps, "rep").repartition("band", "hash", "i", "j")
    return placed.mapInArrow(close, "a long, b long").distinct()


def _united(parent: np.ndarray, a: int, b: int) -> bool:
    """Unite two entries; whether they were apart."""
    while parent[a] != a:
        a = parent[a]
    while parent[b] != b:
        b = parent[b]
    parent[max(a, b)] = min(a, b)
    return a != b


def similar_texts(signatures: DataFrame, key: str, threshold: float = 0.8, n_bands: int = 16, rows: int = 8) -> DataFrame:
    """(key, cluster): for every signed document the smallest key of its class: documents linked by equal or similar
    signatures, directly or through others."""
    signatures = written(signatures)
    edges = similar_pairs(signatures, key, threshold, n_bands, rows, forest=True)
    return _by_signature(signatures, key, components(edges), "cluster")


def similar_leaders(signatures: DataFrame, key: str, threshold: float = 0.8, n_bands: int = 16, rows: int = 8) -> DataFrame:
    """(key, keeper): greedy in ascending order; a document goes to the smallest kept one that it is similar to."""
    signatures = written(signatures)
    pairs = written(similar_pairs(signatures, key, threshold, n_bands, rows))
    reps = signatures.groupBy("signature").agg(F.min(key).cast("long").alias("id"))
    return _by_signature(signatures, key, keep_first(reps.select("id"), pairs).withColumnRenamed("id", "node").withColumnRenamed("keeper", "root"), "keeper")


def _by_signature(signatures: DataFrame, key: str, roots: DataFrame, name: str) -> DataFrame:
    """Every document with its signature's root, or the signature's smallest key."""
    of = signatures.groupBy("signature").agg(F.min(key).cast("long").alias("node")).join(roots, "node", "left").select("signature", F.coalesce("root", "node").alias(name))
    return skew_join(signatures, of, ["signature"]).select(key, name)


class SignatureIndex:
    """Signed documents in a folder of the shared storage, each batch its own file set; opened again by its path."""

    def __init__(self, spark: SparkSession, path: str, n: int = 5, permutations: int = 128, n_bands: int = 16, rows: int = 8):
        self.spark, self.path = spark, path
        if n_bands * rows > permutations or min(n, permutations, n_bands, rows) < 1:
            raise ValueError("bands times rows: at most the permutations, all positive")
        self.n, self.permutations, self.n_bands, self.rows = n, permutations, n_bands, rows

    def signatures(self) -> DataFrame:
        return self.spark.read.schema("id long, hash string, signature array<bigint>").parquet(f"{self.path}/signatures")

    def _signed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        own = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        return own.select("id", F.sha2("text", 256).alias("hash")).join(minhash(own, "id", "text", self.n, self.permutations), "id", "left")

    def insert(self, df: DataFrame, key: str, text: str) -> None:
        self._signed(df, key, text).write.mode("append").parquet(f"{self.path}/signatures")

    def query(self, df: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
        """(key, match, similarity): the stored documents with the same text (1.0) or a similar signature, best first."""
        asked, held = self._signed(df, key, text), self.signatures()
        exact = asked.select(F.col("id").alias(key), "hash").join(held.select(F.col("id").alias("match"), "hash"), "hash").select(key, "match", F.lit(1.0).alias("similarity"))
        band = lambda x: bands(x.filter("signature is not null").select("id", "signature"), "id", self.n_bands, self.rows)
        pairs = band(asked).withColumnRenamed("id", key).join(band(held).withColumnRenamed("id", "match"), ["band", "hash"]).select(key, "match").distinct()
        near = pairs.join(asked.select(F.col("id").alias(key), F.col("signature").alias("x")), key).join(held.select(F.col("id").alias("match"), F.col("signature").alias("y")), "match")
        near = near.select(key, "match", estimated_jaccard(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= threshold)
        return exact.unionByName(near).groupBy(key, "match").agg(F.max("similarity").alias("similarity")).orderBy(key, F.desc("similarity"), "match")


def overall(exact: DataFrame, near: DataFrame) -> DataFrame:
    """One row from an exact report and near pairs: duplicates, affected rows of near pairs, rate of both (at most 1), advice."""
    affected = near.select(F.explode(F.array("a", "b")).alias("k")).agg(F.count_distinct("k").alias("affected"))
    rate = F.when(F.col("rows") > 0, F.least((F.col("duplicates") + F.col("affected")) / F.col("rows"), F.lit(1.0))).otherwise(0.0)
    advice = F.when(rate > 0.3, "remove_duplicates").when(rate > 0.1, "review_duplicates").when(rate > 0, "minor_duplicates").otherwise("none")
    return exact.crossJoin(F.broadcast(affected)).select("rows", "duplicates", "affected", rate.alias("rate"), advice.alias("advice"))


def keep_first(nodes: DataFrame, pairs: DataFrame, key: str = "id", most_rounds: int | None = None) -> DataFrame:
    """(key, keeper): in ascending order a key is removed if a kept smaller one is its neighbour; keeper is the smallest.

    Rounds of joins decide all keys whose smaller neighbours are decided, until none is open; each round is written and
    the one before it deleted. A bound on the rounds raises if keys are still open then.
    """
    spark = nodes.sparkSession
    folder = shared_dir(spark)
    edges = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{folder}/edges")
    # NULL: undecided
    state = written(nodes.select(F.col(key).alias("k")).distinct().withColumn("kept", F.lit(None).cast("boolean")), f"{folder}/0")
    for done in count(1):
        seen = edges.join(state.select(F.col("k").alias("a"), F.col("kept").alias("_a")), "a").groupBy(F.col("b").alias("k")).agg(F.max(F.coalesce("_a", F.lit(False)).cast("int")).alias("_some"), F.max(F.col("_a").isNull().cast("int")).alias("_open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("_some") == 1, False).when(F.coalesce("_open", F.lit(0)) == 0, True)
        state = written(state.join(seen, "k", "left").select("k", new.alias("kept")), f"{folder}/{done}")
        dropped(spark, f"{folder}/{done - 1}")
        if state.filter("kept is null").isEmpty():
            break
        if done == most_rounds:
            raise RuntimeError(f"keep_first: keys are undecided after {most_rounds} rounds")
    keepers = edges.join(state.filter("kept").select(F.col("k").alias("a")), "a").groupBy(F.col("b").alias("k")).agg(F.min("a").alias("keeper"))
    return state.join(keepers, "k", "left").select(F.col("k").alias(key), F.when(F.col("kept"), F.col("k")).otherwise(F.col("keeper")).alias("keeper"))


def components(edges: DataFrame, share: int = SHARE) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes with a link. edges: (a, b), any direction.

    Large-star then small-star until nothing changes; each half is written to the shared folder and the one before it
    deleted. A centre with over one in `share` of the edges has them spread over all tasks.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark)
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{folder}/0")
    size, state, turn = now.count(), None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("count"))
        large = skew_join(both.filter("b > a"), low.select("a", "m"), ["a"], share=share, counts=low, rows=2 * size)
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), f"{folder}/{turn + 1}")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count"))
        small = skew_join(large, low.select("a", "m"), ["a"], share=share, counts=low, rows=size)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.filter("a <> b").distinct(), f"{folder}/{turn + 2}")
        dropped(spark, f"{folder}/{turn}")
        dropped(spark, f"{folder}/{turn + 1}")
        turn += 2
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.countDistinct("a")).first()
        if after[0] == after[2] and after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        size, state = after[0], after


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): connected components by their smallest id."""
    return components(pairs.select("a", "b")).select(F.col("node").alias("id"), F.col("root").alias("cluster"))


def near_rows(df: DataFrame, key: str, columns: Sequence[str], threshold: float = 0.8, least: int = 2, most: int | None = 100) -> DataFrame:
    """(a, b, similarity): rows in one bucket of a single min-hash over their cells whose cell sets agree.

    Buckets with fewer than `least` or more than `most` rows are skipped, as the operator defines; `near_rows_skipped` says
    how many rows that leaves out, and most=None skips none.
    """
    own = _bucketed_rows(df, key, columns)
    sized = own.join(own.groupBy("h").count().filter((F.col("count") >= least) & (F.lit(True) if most is None else F.col("count") <= most)).select("h"), "h")
    pairs = sized.select("h", F.col("k").alias("a"), F.col("s").alias("sa")).join(sized.select("h", F.col("k").alias("b"), F.col("s").alias("sb")), "h").filter("a < b")
    return pairs.withColumn("similarity", F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def _bucketed_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    cells = F.array_distinct(F.array(*(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns)))
    return df.select(F.col(key).alias("k"), cells.alias("s")).withColumn("h", F.array_min(F.transform("s", lambda x: F.md5(x))))


def near_rows_skipped(df: DataFrame, key: str, columns: Sequence[str], most: int = 100) -> DataFrame:
    """One row: buckets and rows beyond the bound of `near_rows`."""
    sizes = _bucketed_rows(df, key, columns).groupBy("h").count().filter(F.col("count") > most)
    return sizes.agg(F.count("*").alias("buckets"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))


def bucket_stats(banded: DataFrame, key: str) -> DataFrame:
    """documents, buckets, entries and entries a bucket."""
    sizes = banded.groupBy("band", "hash").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("buckets"), F.sum("n").alias("entries"), F.avg("n").alias("mean")).crossJoin(banded.agg(F.count_distinct(key).alias("documents")))


def leaders(df: DataFrame, key: str, text: str, dataset: str) -> DataFrame:
    """Per dataset: rows, exact duplicates of a smaller key, and those whose first copy is in another dataset."""
    got = exact_text(df, key, text)
    first = df.select(F.col(key).alias("cluster"), F.col(dataset).alias("_from"))
    return got.join(first, "cluster").groupBy(dataset).agg(F.count("*").alias("rows"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("is_duplicate") & (F.col("_from") != F.col(dataset))).alias("cross_dataset"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row a key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
