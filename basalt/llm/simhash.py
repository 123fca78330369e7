"""Operator 3: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made distinct, routed by blocks of their bits (two that differ in at most k bits agree on one of k + 1
blocks), and each task indexes what it got: entries of one routing key are sorted by the Gray rank of their bits, up to
eight neighbours share a node that holds the bits they agree on, up to eight nodes a node above, and so on. A search
walks all entries down the levels together, adding up the differences in the bits each node adds, and drops a whole
node once they exceed k. A task returns a spanning forest of the links it found, never all pairs; components are then
joined over all tasks by alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import components
from ..operators.skew import skew_join
from .common import arrow_map, bound_batches, utf8, written

SEED = 42
#: Entries of one routing key that a task takes; keys with more are routed on, by blocks of their remaining bits.
HOT = 20_000
#: Neighbours below one node, and pairs that a search holds at a time.
FAN, FRONTIER = 8, 1 << 21


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter((b" ".join(words),))
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint column, long. Words are split at ASCII white space and A-Z lower-cased."""

    @F.arrow_udf("bigint")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array([simhash(t, shingle) for t in utf8(column)], pa.int64())

    return prints(text)


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """The bits in n blocks of nearly equal size."""
    return [list(map(int, b)) for b in np.array_split(np.array(bits), n)]


def routes(k: int, depth: int) -> list[tuple[int, ...]]:
    """Masks by level: every route of a level is a mask that agrees with one of k + 1 blocks of what is left above it."""
    masks = [0]
    levels = []
    for _ in range(depth):
        masks = [m | sum(1 << b for b in block) for m in masks for block in blocks([b for b in range(64) if not m >> b & 1], k + 1)]
        levels.append(tuple(masks))
    return levels


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over entries sorted by (group, Gray rank). groups: equal numbers search among each other."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.order = np.lexsort((gray_rank(values), groups))
        self.values, groups = values[self.order], groups[self.order]
        n = len(values)
        first = np.arange(n)
        both, either, self.levels = self.values.copy(), self.values.copy(), []
        ends = np.arange(1, n + 1)
        while True:
            fresh = np.concatenate(([True], groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, bool)
            start = np.flatnonzero(fresh)
            within = np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))
            heads = np.flatnonzero(within % FAN == 0)
            if len(heads) == len(groups):
                break
            child_end = np.append(heads[1:], len(groups))
            both, either = np.bitwise_and.reduceat(both, heads), np.bitwise_or.reduceat(either, heads)
            ends, groups = ends[child_end - 1], groups[heads]
            self.levels.append({"mask": ~(both ^ either), "pattern": both, "lo": heads, "hi": child_end, "end": ends})
        self.groups, self.first = groups, first

    def links(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (in the given order) that differ in at most k bits, a bounded batch at a time."""
        n = len(self.values)
        if not self.levels:
            return
        top = self.levels[-1]
        root = np.searchsorted(top["end"], np.arange(n), "right")
        size = np.diff(np.concatenate(([0], top["end"])))[root]
        busy = np.flatnonzero(size > 1)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[busy]) // FRONTIER)) + 1
        for query in np.split(busy, cuts):
            node, above, q = root[query], np.zeros(len(query), np.uint64), query
            acc = np.zeros(len(query), np.uint8)
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                acc = acc + np.bitwise_count((self.values[q] ^ level["pattern"][node]) & level["mask"][node] & ~above)
                keep = (acc <= k) & (level["end"][node] > q + 1)
                q, node, acc = q[keep], node[keep], acc[keep]
                above = level["mask"][node]
                width = level["hi"][node] - level["lo"][node]
                below = np.repeat(level["lo"][node] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                q, acc, above, node = np.repeat(q, width), np.repeat(acc, width), np.repeat(above, width), below
            keep = node > q
            q, node, acc, above = q[keep], node[keep], acc[keep], above[keep]
            acc = acc + np.bitwise_count((self.values[q] ^ self.values[node]) & ~above)
            found = acc <= k
            yield self.order[q[found]], self.order[node[found]]


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the ends of all links in a forest whose roots are the smallest members."""
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = parent[x]
    while (y := parent[x]).tobytes() != x.tobytes():
        x = y
    return x


def forest(values: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Per entry the place of the first entry of its component among the links within groups."""
    parent = np.arange(len(values))
    for a, b in GrayIndex(values, groups).links(k):
        joined(parent, a, b)
    return _roots(parent, parent)


def _local_links(k: int):
    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(it)) if (it := list(it)) else None
        if table is None or not table.num_rows:
            return
        route, key, value, rep = (table.column(c).to_numpy() for c in ("route", "key", "fp", "rep"))
        _, groups = np.unique(np.stack([route.astype(np.int64), key]), axis=1, return_inverse=True)
        order = np.argsort(rep, kind="stable")  # so that the first of a component has the smallest id
        root = forest(value[order].view(np.uint64), groups.reshape(-1)[order], k)
        rep = rep[order]
        linked = root != np.arange(len(root))
        yield from pa.table({"a": rep[linked], "b": rep[root[linked]]}).to_batches(max_chunksize=10_000)

    return links


def links(prints: DataFrame, k: int = 2, hot: int = HOT) -> DataFrame:
    """A spanning set (a, b), a > b, of the links between distinct fingerprints. prints: (fp, rep), both distinct.

    A routing key with more than `hot` fingerprints is routed on by blocks of its other bits, to 45 of 64 bits for
    k = 2: no task gets more than 2**19 entries of a key.
    """
    found = None
    rows = prints
    levels = routes(k, 3)
    for depth, masks in enumerate(levels):
        if depth == 0:
            paths = [(i, m) for i, m in enumerate(masks)]
            routed = rows.select("fp", "rep", F.explode(F.array(*(F.struct(F.lit(i).alias("route"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in paths))).alias("r")).select("fp", "rep", "r.*")
        else:
            options = [F.array(*(F.struct(F.lit(i * (k + 1) + j).alias("route"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i * (k + 1) + j]))).alias("key")) for j in range(k + 1))) for i in range(len(levels[depth - 1]))]
            pick = F.element_at(F.array(*options), F.col("route") + 1)
            routed = rows.select("fp", "rep", F.explode(pick).alias("r")).select("fp", "rep", "r.*")
        counts = routed.groupBy("route", "key").count().filter("count > 1")
        sized = skew_join(routed, counts, ["route", "key"], counts=counts, rows=rows.count() * (k + 1))
        last = depth == len(levels) - 1
        own = sized if last else sized.filter(F.col("count") <= hot)
        part = arrow_map(own.select("route", "key", "fp", "rep").repartition("route", "key"), _local_links(k), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        rows = sized.filter(F.col("count") > hot).select("route", "fp", "rep")
        if counts.filter(F.col("count") > hot).isEmpty():
            break
    return found.distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: A signature is this many fingerprints of 64 bits; MinHash bands that route it, and minima of a band.
PRINTS, BANDS, ROWS = 4, 20, 4
#: Bits in which fingerprints that link differ at most.
NEAR = 2
#: Texts of one candidate component that are compared at a time, block against block.
BLOCK = 1000
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) << np.uint64(1) | np.uint64(1)


def shingled(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))


def digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.astype("<u8").tobytes(), digest_size=16).digest()


def signature(h: np.ndarray) -> list[int]:
    """Fingerprints of the shingles' hashes under PRINTS hashes."""
    bits = np.zeros((PRINTS, 64), np.int64)
    for at in range(0, len(h), 1 << 13):
        part = h[at : at + (1 << 13), None] + np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        raw = np.ascontiguousarray(part).astype("<u8").view(np.uint8).reshape(len(part), PRINTS * 8)
        bits += np.add.reduce(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, dtype=np.int64).reshape(PRINTS, 64)
    return np.packbits(2 * bits > len(h), axis=1, bitorder="little").reshape(-1).view("<i8").tolist()


def bands(h: np.ndarray) -> list[int]:
    """A key for each band of ROWS minima."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 1 << 13):
        part = (h[at : at + (1 << 13)] ^ _SALTS) * np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(32)
        least = np.minimum(least, (part * _SALTS).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        key = (key ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


def differing(similarity: float) -> int:
    """Bits of a signature that differ between texts of this Jaccard similarity: the mean and four standard errors.

    Bits differ by the angle between the shingle sets, over pi. Of sets with similarity s those of equal size have the
    widest angle, of cosine 2s / (1 + s), wherever the shingles that differ stand in the texts.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(PRINTS * 64 * p + 4 * np.sqrt(PRINTS * 64 * p * (1 - p))))


def _forest_edges(rep: np.ndarray, parent: np.ndarray) -> Iterator[pa.RecordBatch]:
    root = _roots(parent, parent)
    linked = rep != rep[root]
    yield from pa.table({"a": rep[linked], "b": rep[root[linked]]}).to_batches(max_chunksize=10_000)


def _candidates(most: int):
    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures of one cell against each other, at growing distance of their places."""
        held = list(it)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        cell = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        rep = table.column("rep").to_numpy()
        order = np.lexsort((rep, *cell[::-1]))
        cell, rep = cell[:, order], rep[order]
        fresh = np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)))
        prints = table.column("s").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)[order]
        start, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        end = np.append(start[1:], len(rep))[group]
        parent, at, step = np.arange(len(rep)), np.arange(len(rep)), 0
        while len(at):
            step += 1
            at = at[at + step < end[at]]
            close = np.bitwise_count(prints[at] ^ prints[at + step]).sum(axis=1, dtype=np.int64) <= most
            joined(parent, at[close], at[close] + step)
            if step & (step - 1) == 0:  # groups that are one component have nothing left to find
                root = _roots(parent, parent)
                at = at[np.logical_or.reduceat(root != start[group], start)[group[at]]]
        yield from _forest_edges(rep, parent)

    return links


def _verified(similarity: float, shingle: int):
    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one pair of blocks against each other, by the exact similarity of their shingle sets."""
        held = list(it)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        cell = np.stack([table.column(c).to_numpy() for c in ("root", "i", "j")])
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        want, text = table.column("digest").to_pylist(), utf8(table.column("text"))
        order = np.lexsort((rep, *cell[::-1]))
        cuts = np.flatnonzero((np.diff(cell[:, order], axis=1) != 0).any(axis=0)) + 1
        for part in np.split(order, cuts):
            sets = [shingled(text[k], shingle) for k in part]
            right = np.array([digest(h) == want[k] for h, k in zip(sets, part, strict=True)])  # a repeated id can have other texts
            part, sets = part[right], [h for h, ok in zip(sets, right, strict=True) if ok]
            if len(part) > 1:
                yield from _forest_edges(rep[part], _exact(sets, side[part], similarity))

    return links


def _exact(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """A forest of the pairs with this similarity; of blocks 1 and 2 only pairs across, of block 0 all pairs."""
    sizes = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(code, kind="stable")  # places of each shingle, by owner
    first = np.searchsorted(code[by], np.arange(code.max() + 2))
    posted, at = owner[by], np.cumsum(sizes) - sizes
    parent = np.arange(len(sets))
    for k in range(len(sets) - 1):
        own = code[at[k] : at[k] + sizes[k]]
        lo, width = first[own], first[own + 1] - first[own]
        places = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        both = np.bincount(posted[places], minlength=len(sets))
        near = (both >= similarity * (sizes[k] + sizes - both) - 1e-9) & ((side == 0) | (side != side[k]))
        near[: k + 1] = False
        other = np.flatnonzero(near)
        joined(parent, np.full(len(other), k), other)
    return parent


def indexed_links(prints: DataFrame, k: int = NEAR, hot: int = HOT) -> DataFrame:
    """A spanning set (a, b) of the links between rows whose fingerprints differ in at most k bits. prints: (fp, rep), rep
    distinct; rows with one fingerprint link to the first of them, and fingerprints through the Gray-order index."""
    held = written(prints)
    sizes = written(held.groupBy("fp").agg(F.min("rep").alias("first"), F.count("*").alias("count")))
    same = skew_join(held, sizes.select("fp", "first"), ["fp"], counts=sizes, rows=held.count())
    return links(sizes.select("fp", F.col("first").alias("rep")), k, hot).unionByName(same.filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")))


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents in groups of near copies: similarity or more of their shingles agree.

    Texts with equal shingle sets count once. Sets whose fingerprints differ in at most NEAR bits are candidates, all of them,
    through the Gray-order index. At 0.8 fingerprints differ in about 10 bits, so for pairs that lie farther apart sets that
    agree on one of BANDS keys of ROWS minima are candidates too, if their signatures differ in at most `differing` bits: of
    pairs right at 0.8 that passes all but about one in 10,000, wherever the edits stand. A key with more than `hot` sets is
    searched block against block, which meets the same pairs. So are components of candidates, by the exact similarity of
    the shingle sets; only that links. Texts without words, and rows with null ids, are in no group; repeated ids count once.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<digest:binary,s:array<bigint>,keys:array<bigint>>")
    def signed(column: pa.Array) -> pa.Array:
        rows = [(digest(h), signature(h), bands(h)) if len(h) else (None, None, None) for h in (shingled(t, shingle) for t in utf8(column))]
        kinds = {"digest": pa.binary(), "s": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signs = written(texts.select("doc_id", signed.asNondeterministic()("text").alias("r")).select("doc_id", "r.*"))
    signs = signs.filter("digest is not null and doc_id is not null")
    distinct = written(signs.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("s").alias("s"), F.any_value("keys").alias("keys")))
    routed = distinct.select("rep", "s", F.explode("keys").alias("key"))
    counts = routed.groupBy("key").count().filter("count > 1")
    sized = skew_join(routed, counts, ["key"], counts=counts, rows=distinct.count() * BANDS)
    dealt = _cells(sized.withColumn("n", F.when(F.col("count") <= hot, 1).otherwise(F.ceil(2 * F.col("count") / hot)).cast("int")), F.xxhash64("rep"))
    close = arrow_map(dealt.select("key", "i", "j", "s", "rep").repartition("key", "i", "j"), _candidates(differing(similarity)), "a long, b long")
    close = indexed_links(distinct.select(F.get("s", F.lit(0)).alias("fp"), "rep"), hot=hot).unionByName(close).distinct()
    maybe = written(components(close).withColumnRenamed("node", "rep"))
    sizes = maybe.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"), F.count("*").alias("count"))
    held = skew_join(maybe, sizes.drop("count"), ["root"], counts=sizes, rows=maybe.count()).join(distinct.select("digest", "rep"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    cells = _cells(held, F.xxhash64("rep"))
    edges = arrow_map(cells.select("root", "i", "j", "side", "rep", "digest", "text").repartition("root", "i", "j"), _verified(similarity, shingle), "a long, b long").distinct()
    roots = components(edges)
    of = distinct.join(roots, distinct.rep == roots.node, "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    return skew_join(signs.select("doc_id", "digest"), of, ["digest"]).select("doc_id", "component_id")


def _cells(rows: DataFrame, h: Column) -> DataFrame:
    """Each row in every pair i <= j of the n blocks of its key that holds its own block: all pairs of rows meet.

    side: 0 where a block meets itself, 1 and 2 where two meet.
    """
    n, own = F.col("n"), F.pmod(h, F.col("n")).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), n - 1)))
    side = F.when(F.col("_own") == F.col("_with"), 0).when(F.col("_own") < F.col("_with"), 1).otherwise(2)
    return dealt.withColumns({"i": F.least("_own", "_with"), "j": F.greatest("_own", "_with"), "side": side}).drop("_own", "_with", "n")


def near_duplicates(docs: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of <= k bits).

    Null and empty texts and those without words have fingerprint 0 and link like any other. Repeated rows give repeated
    results; a null id counts for nothing in a component, and its own row gets its fingerprint's component, null if only
    null ids have it. Empty table: no row.
    """
    bound_batches(docs.sparkSession)
    prints = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = links(distinct.filter("rep is not null"), k)
    roots = components(edges)
    of = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return skew_join(prints, of, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
