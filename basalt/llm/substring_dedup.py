"""Operator 10: exact removal of repeated 13-word passages through a log-structured fingerprint index.

Every window of 13 words is represented by the smallest hash among its 7-word windows, so equal windows always have
equal representatives, and a text has about one for every four words. The index keeps them in sorted immutable runs,
one run a batch of documents; the runs' rows are sorted blocks of one hash bucket each, of bounded size. A new batch is
merge-joined with all runs bucket by bucket: hashes that stand in two blocks come back as one bit per block entry,
and the blocks tell which documents hold them. Then the windows around those hashes, in new and old documents, are
verified by a 128-bit hash of their words' bytes, and a window is covered if a smaller document id holds it; what comes
back for a document are the ranges of its covered windows. Runs have
levels: `fan` runs of one level are merged into one of the next, so that an entry is rewritten once a level. A manifest,
replaced as a whole after each batch, names the runs, and an index is opened again from its folder.

What goes to one task is a bucket's distinct hashes of each block; a hash that a third of all documents hold comes
once a block. Its documents stay spread over the blocks. The number of buckets follows the size of the input.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, dropped, get_text, names, put_text, shared_dir, stored, utf8, written

#: Words of a window, and of the shorter windows that represent it.
WINDOW, GRAM = 13, 7
#: Index entries of one block row at most, and words that are hashed at a time.
BLOCK, WORDS = 1_000_000, 1_500_000
#: Entries of one bucket, about, and characters of text for each; a bucket is what one task holds at a time.
BUCKET, CHARS = 1 << 19, 24
#: Buckets are 2**LEAST_BITS to 2**MOST_BITS, the top bits of the hashes.
LEAST_BITS, MOST_BITS = 4, 20

# Odd multipliers of the rolling hash and of the final mixing.
BASE1 = 0x9E3779B97F4A7C15
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: firsts: one bit an entry, set where a new key (and check) starts; docs: byte planes.
BLOCK_SCHEMA = "run string, chunk string, bucket long, keys binary, docs binary, firsts binary"
#: Blocks of windows to verify, with the second half of their hashes, their places in their texts, and the texts' tags.
WINDOW_SCHEMA = BLOCK_SCHEMA + ", checks binary, places binary, tags binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def _rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values, by doubling."""
    out, width, power = None, 0, 1
    step, size, p = h, 1, base
    while n:
        if n & 1:
            if out is None:
                out, width, power = step, size, p
            else:
                keep = len(h) - width - size + 1
                out = out[: max(keep, 0)] + np.uint64(power) * step[width : width + max(keep, 0)]
                width, power = width + size, power * p % (1 << 64)
        n >>= 1
        if n:
            keep = max(len(step) - size, 0)
            step = step[:keep] + np.uint64(p) * step[size : size + keep]
            size, p = 2 * size, p * p % (1 << 64)
    return out


class Windows:
    """The windows of some texts, laid end to end. at: where each starts among all words; text: its text.

    Of the words only hashes are kept; fingerprints() asks for those of the texts that it needs, one text at a time.
    """

    def __init__(self, texts: Sequence[list[bytes]]):
        self.texts = texts
        own = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in texts]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.words = np.concatenate([np.zeros(0, np.uint64), *own])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = max(int(sizes.sum()) - WINDOW + 1, 0)
        text = np.repeat(np.arange(len(texts)), sizes)
        self.at = np.flatnonzero(text[:n] == text[WINDOW - 1 :][:n])
        self.text = text[self.at]

    def representatives(self) -> np.ndarray:
        """Per window the smallest hash of its grams."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        g = _mixed(_rolled(self.words, GRAM, BASE1))
        span, size = WINDOW - GRAM + 1, 1
        low = g
        while 2 * size <= span:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        return low[self.at]

    def fingerprints(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The halves of a 128-bit hash of each window's words, joined by one space; keep: which windows."""
        keep = np.ones(len(self.at), bool) if keep is None else keep
        at, text, found = self.at[keep], self.text[keep], []
        upto = np.searchsorted(text, np.arange(len(self.texts) + 1))
        for k in np.flatnonzero(np.diff(upto)).tolist():
            words = self.texts[k]
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            own = at[upto[k] : upto[k + 1]] - self.starts[k]
            raw, begin = b" ".join(words), np.concatenate(([0], ends))[own].tolist()
            found += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin, (ends[own + WINDOW - 1] - 1).tolist(), strict=True)]
        halves = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]


def _planes(x: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, which compresses where they are small or sorted."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def _u64(b: bytes | None) -> np.ndarray:
    return np.frombuffer(b or b"", "<u8")


def _grouped(it: Iterator[pa.RecordBatch], weight: Callable[[dict], int]) -> Iterator[list[dict]]:
    """Texts' rows in groups of about WORDS words."""
    held, size = [], 0
    for batch in it:
        for row in batch.to_pylist():
            held.append(row)
            size += weight(row)
            if size >= WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _blocks(entries: Iterator[tuple[np.ndarray, ...]], run: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted block rows of entries, one for each bucket of a chunk: (key, doc), each once, or (key, doc, check, place, tag).

    The entries of a document are in one chunk.
    """
    task, held, size = TaskContext.get().partitionId(), [], 0
    chunks = itertools.count()

    def flush() -> Iterator[pa.RecordBatch]:
        keys, docs, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((docs, *rest[:1], keys))
        keys, docs, rest = keys[order], docs[order], [x[order] for x in rest]
        if not rest:
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs = keys[fresh], docs[fresh]
        chunk, bucket = f"{task}-{next(chunks)}", (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _block(run, chunk, int(bucket[a]), keys[a:b], docs[a:b], *(x[a:b] for x in rest))

    for entry in entries:
        held.append(entry)
        size += len(entry[0])
        if size >= BLOCK:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _block(run: str, chunk: str, bucket: int, keys: np.ndarray, docs: np.ndarray, checks: np.ndarray | None = None, places: np.ndarray | None = None, tags: np.ndarray | None = None) -> pa.RecordBatch:
    row = {"run": run, "chunk": chunk, "bucket": bucket, "keys": keys.tobytes(), "docs": _planes(docs), "firsts": np.packbits(_fresh(keys, checks)).tobytes()}
    if checks is not None:
        row |= {"checks": checks.tobytes(), "places": _planes(places), "tags": _planes(tags)}
    return _row(row)


def _row(row: dict) -> pa.RecordBatch:
    kind = {str: pa.string(), int: pa.int64(), bytes: pa.binary()}
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, kind[type(v)]) for n, v in row.items()]))


def _by(it: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys, a row in memory at a time."""
    yield from itertools.groupby((row for batch in it for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist()), key=lambda r: tuple(r[k] for k in key))


def _answered(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Block rows and the replies to some of them, all of a chunk in one task, a reply right after its row."""
    sent = [c for c in blocks.columns if c not in ("run", "chunk", "bucket")]
    both = blocks.withColumn("reply", F.lit(None).cast("binary")).unionByName(replies.select("run", "chunk", "bucket", *(F.lit(None).cast("binary").alias(c) for c in sent), "reply"))
    return both.repartition("run", "chunk").sortWithinPartitions("run", "chunk", "bucket", F.col("reply").isNotNull())


def _pairs(rows: Iterator[dict]) -> Iterator[tuple[dict, bytes]]:
    last = None
    for row in rows:
        if row["reply"] is None:
            last = row
        else:
            yield last, row["reply"]


def _lists(columns: dict[str, np.ndarray], owner: np.ndarray, lists: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal owners: columns' first values, lists' values as lists."""
    at = np.flatnonzero(np.concatenate(([True], (owner[:, 1:] != owner[:, :-1]).any(axis=0)))) if owner.shape[1] else np.zeros(0, np.int64)
    cuts = pa.array(np.append(at, owner.shape[1]).astype(np.int32))
    table = pa.table({**{n: x[at] for n, x in columns.items()}, **{n: pa.ListArray.from_arrays(cuts, pa.array(x)) for n, x in lists.items()}})
    yield from table.to_batches(max_chunksize=1000)


def _fresh(keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
    """Whether each entry of a sorted block starts a new (key, check)."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    if checks is not None:
        fresh[1:] |= checks[1:] != checks[:-1]
    return fresh


def _starts(firsts: bytes, n: int) -> np.ndarray:
    """Where each distinct (key, check) of a stored block of n entries starts."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(firsts, np.uint8), count=n))


class _Words(Sequence):
    """The words of rows' texts, split when asked for: a group's words as objects would take ten times its texts' size."""

    def __init__(self, rows: list[dict]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, at: int) -> list[bytes]:
        return (self.rows[at]["text"] or b"").split()


def _raw(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def tag_of(text: bytes) -> int:
    """What tells texts under one id apart, never 0."""
    return int(np.array(xxhash.xxh3_64_intdigest(text) | 1, np.uint64).view(np.int64))


def bits_for(chars: int) -> int:
    """Bits of the bucket numbers for about that many characters of text."""
    return min(max(int(chars // CHARS // BUCKET).bit_length(), LEAST_BITS), MOST_BITS)


class FingerprintIndex:
    """The index in a folder of the shared storage, opened if there is one.

    bits: the buckets are the top bits of the hashes; fan: runs of a level that are merged; both are kept from the first
    opening. One writer at a time: of two, the second to commit fails.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bits: int | None = None, fan: int = 2):
        self.spark, self.path = spark, path or shared_dir(spark)
        kept = [n for n in names(spark, f"{self.path}/manifest") if n.endswith(".json")]
        if kept:
            state = json.loads(get_text(spark, f"{self.path}/manifest/{kept[-1]}"))
            if bits not in (None, state["bits"]):
                raise ValueError(f"the index in {self.path} has {state['bits']} bits")
            self.bits, self.fan, self.made, self.commits = state["bits"], state["fan"], state["made"], int(kept[-1][:12])
            self.levels = {n: level for n, level in state["runs"]}
        else:
            self.bits, self.fan, self.made, self.commits, self.levels = bits or LEAST_BITS + 2, fan, 0, 0, {}

    @property
    def runs(self) -> list[str]:
        return list(self.levels)

    def _commit(self, levels: dict[str, int]) -> None:
        """From here on these are the runs; then what the last manifest named beyond them is deleted."""
        state = {"bits": self.bits, "fan": self.fan, "made": self.made, "runs": list(levels.items())}
        put_text(self.spark, f"{self.path}/manifest/{self.commits + 1:012d}.json", json.dumps(state))
        old, self.levels, self.commits = self.levels, levels, self.commits + 1
        for n in set(old) - set(levels):
            dropped(self.spark, f"{self.path}/{n}")
        dropped(self.spark, f"{self.path}/manifest/{self.commits - 1:012d}.json")

    def _write(self, rows: DataFrame, name: str) -> None:
        stored(rows, f"{self.path}/{name}", "zstd")

    def _name(self) -> str:
        self.made += 1
        return f"run-{self.made}"

    def blocks(self, runs: list[str] | None = None) -> DataFrame:
        """The runs' block rows."""
        runs = self.runs if runs is None else runs
        return reduce(DataFrame.unionByName, (self.spark.read.schema(BLOCK_SCHEMA).parquet(f"{self.path}/{n}") for n in runs))

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch as a run, and merge-join it with every run: (doc_id, gram), the hashes that stand in this batch and in
        another document too, with all documents, old and new, that hold them. The result is stored beside the index.

        The run is committed after the join, so that a batch that fails leaves the index as it was.
        """
        name, bits = self._name(), self.bits

        def entries(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for rows in _grouped(it, lambda r: len(r["text"] or b"") // 6):
                ids = np.array([r["doc_id"] for r in rows], np.int64)
                windows = Windows(_Words(rows))
                low, owner = windows.representatives(), windows.text
                fresh = np.ones(len(low), bool)
                fresh[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                yield low[fresh], ids[owner[fresh]]

        self._write(arrow_map(_raw(docs, id_col, text_col).filter("doc_id is not null"), lambda it: _blocks(entries(it), name, bits), BLOCK_SCHEMA), name)
        found = stored(self._shared_with(name), f"{self.path}/found-{self.made}")
        self._commit({**self.levels, name: 0})
        self.compact()
        return found

    def _shared_with(self, name: str) -> DataFrame:
        """Candidates that run `name` brings."""

        def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for row in batch.to_pylist():
                    keys = _u64(row["keys"])
                    at = _starts(row["firsts"], len(keys))
                    many = np.diff(np.append(at, len(keys))) > 1
                    yield _row({"run": row["run"], "chunk": row["chunk"], "bucket": row["bucket"], "keys": keys[at].tobytes(), "many": np.packbits(many).tobytes()})

        def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bucket,), rows in _by(it, "bucket"):
                rows = list(rows)
                sizes = np.array([len(r["keys"]) // 8 for r in rows])
                keys = np.concatenate([_u64(r["keys"]) for r in rows])
                many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=n).astype(bool) for r, n in zip(rows, sizes, strict=True)])
                fresh = np.repeat([r["run"] == name for r in rows], sizes)
                order = np.argsort(keys, kind="stable")
                at = np.flatnonzero(_fresh(keys[order]))
                width = np.diff(np.append(at, len(keys)))
                hot = ((width > 1) | np.logical_or.reduceat(many[order], at)) & np.logical_or.reduceat(fresh[order], at) if len(at) else np.zeros(0, bool)
                back = np.zeros(len(keys), bool)
                back[order] = np.repeat(hot, width)
                for row, part in zip(rows, np.split(back, np.cumsum(sizes)[:-1]), strict=True):
                    if part.any():
                        yield _row({"run": row["run"], "chunk": row["chunk"], "bucket": bucket, "reply": np.packbits(part).tobytes()})

        def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _by(it, "run", "chunk"):
                for row, reply in _pairs(rows):
                    keys = _u64(row["keys"])
                    at = _starts(row["firsts"], len(keys))
                    hot = np.unpackbits(np.frombuffer(reply, np.uint8), count=len(at)).astype(bool)
                    keep = np.repeat(hot, np.diff(np.append(at, len(keys))))
                    yield from pa.table({"doc_id": _unplaned(row["docs"])[keep], "gram": keys[keep].view("<i8")}).to_batches(max_chunksize=10_000)

        blocks = self.blocks([*self.runs, name])
        sent = arrow_map(blocks.select("run", "chunk", "bucket", "keys", "firsts"), keyed, "run string, chunk string, bucket long, keys binary, many binary")
        hot = arrow_map(sent.repartition("bucket").sortWithinPartitions("bucket"), merged, "run string, chunk string, bucket long, reply binary")
        return arrow_map(_answered(blocks, hot), candidates, "doc_id long, gram long")

    def compact(self) -> None:
        """Merge the runs of a level, once there are `fan` of them, into one run of the next; other levels stay."""
        while full := [x for x in set(self.levels.values()) if list(self.levels.values()).count(x) >= self.fan]:
            level = min(full)
            old, name = [n for n, x in self.levels.items() if x == level], self._name()
            self._write(arrow_map(self.blocks(old).repartition("bucket").sortWithinPartitions("bucket"), _merged(name), BLOCK_SCHEMA), name)
            self._commit({**{n: x for n, x in self.levels.items() if n not in old}, name: level + 1})


def _merged(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Block rows of a bucket made one; blocks stay below BLOCK entries, or the size of one row."""

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), itertools.count()

        def flush(bucket: int, held: list) -> pa.RecordBatch:
            keys, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((docs, keys))
            return _block(name, f"{task}-{next(nth)}", bucket, keys[order], docs[order])

        for (bucket,), rows in _by(it, "bucket"):
            held, size = [], 0
            for row in rows:
                own = (_u64(row["keys"]), _unplaned(row["docs"]))
                if held and size + len(own[0]) > BLOCK:
                    yield flush(bucket, held)
                    held, size = [], 0
                held.append(own)
                size += len(own[0])
            if held:
                yield flush(bucket, held)

    return merged


#: Bits of the membership table that keeps texts without work out of a shuffle.
MEMBER_BITS = 1 << 22


def maybe_member(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """rows with `maybe`: false only if the key is not among ids (doc_id). rows has none of the names used here.

    The table has MEMBER_BITS bits whatever the input, 65,536 rows of 64 at most, and so can be broadcast. With very many
    ids it fills up and keeps out fewer rows; results never depend on it.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MEMBER_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 as int))")
    table = ids.select(place(F.col("doc_id")).alias("at")).select(F.shiftright("at", 6).alias("word"), bit("at").alias("bit"))
    table = table.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = rows.withColumn("at", place(key)).withColumn("word", F.shiftright("at", 6))
    joined = own.join(F.broadcast(table), "word", "left")
    return joined.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(bit("at")) != 0, F.lit(False)).alias("maybe"))


def covered_windows(docs: DataFrame, candidates: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verify candidates (doc_id, gram): (doc_id, tag, starts, lengths), the ranges of the windows that also start in a
    smaller document. tag: 0, or the tag of the text if other rows have the same id. Written to the shared folder.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    raw = _raw(docs, id_col, text_col)
    many = raw.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("many"))
    wanted = candidates.groupBy("doc_id").agg(F.collect_set("gram").alias("grams")).join(many, "doc_id", "left")

    def entries(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for rows in _grouped(it, lambda r: len(r["text"] or b"") // 6):
            ids = np.array([r["doc_id"] for r in rows], np.int64)
            tags = np.array([tag_of(r["text"]) if r["many"] else 0 for r in rows], np.int64)
            windows = Windows(_Words(rows))
            low, owner = windows.representatives().view("<i8"), windows.text
            upto = np.searchsorted(owner, np.arange(len(rows) + 1))
            keep = np.concatenate([np.isin(low[a:b], np.array(r["grams"], np.int64)) for r, a, b in zip(rows, upto[:-1], upto[1:], strict=True)])
            own = owner[keep]
            hi, lo = windows.fingerprints(keep)
            yield hi, ids[own], lo, windows.at[keep] - windows.starts[own], tags[own]

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                keys, checks, ids = _u64(row["keys"]), _u64(row["checks"]), _unplaned(row["docs"])
                at = _starts(row["firsts"], len(keys))
                yield _row({"run": row["run"], "chunk": row["chunk"], "bucket": row["bucket"], "keys": keys[at].tobytes(), "checks": checks[at].tobytes(), "docs": _planes(ids[at])})

    def least(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _by(it, "bucket"):
            rows = list(rows)
            keys, checks, ids = (np.concatenate(x) for x in zip(*((_u64(r["keys"]), _u64(r["checks"]), _unplaned(r["docs"])) for r in rows), strict=True))
            order = np.lexsort((ids, checks, keys))
            at = np.flatnonzero(_fresh(keys[order], checks[order]))
            own = np.empty(len(keys), np.int64)
            own[order] = np.repeat(ids[order][at], np.diff(np.append(at, len(keys))))
            for row, part in zip(rows, np.split(own, np.cumsum([len(r["keys"]) // 8 for r in rows])[:-1]), strict=True):
                yield _row({"run": row["run"], "chunk": row["chunk"], "bucket": bucket, "reply": _planes(part)})

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by(it, "run", "chunk"):
            held = []
            for row, reply in _pairs(rows):
                ids = _unplaned(row["docs"])
                later = ids > np.repeat(_unplaned(reply), np.diff(np.append(_starts(row["firsts"], len(ids)), len(ids))))
                held.append(np.stack([ids[later], _unplaned(row["tags"])[later], _unplaned(row["places"])[later]]))
            own = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)
            if own.shape[1]:
                own = own[:, np.lexsort(own[::-1])]
                at = np.flatnonzero(np.concatenate(([True], (np.diff(own, axis=1) != [[0], [0], [1]]).any(axis=0))))
                lengths = np.diff(np.append(at, own.shape[1]))
                own = own[:, at]
                yield from _lists({"doc_id": own[0], "tag": own[1]}, own[:2], {"starts": own[2].astype(np.int32), "lengths": lengths.astype(np.int32)})

    sought = maybe_member(raw, F.col("doc_id"), candidates).filter("maybe").drop("maybe").join(wanted, "doc_id")
    blocks = written(arrow_map(sought, lambda it: _blocks(entries(it), "", bits), WINDOW_SCHEMA), path)
    asked = arrow_map(blocks.select("run", "chunk", "bucket", "keys", "checks", "docs", "firsts"), keyed, "run string, chunk string, bucket long, keys binary, checks binary, docs binary")
    lows = arrow_map(asked.repartition("bucket").sortWithinPartitions("bucket"), least, "run string, chunk string, bucket long, reply binary")
    out = written(arrow_map(_answered(blocks.drop("keys", "checks"), lows), found, f"doc_id long, {RANGES}"))
    dropped(spark, path)
    return out


#: Ranges of covered windows.
RANGES = "tag long, starts array<int>, lengths array<int>"
_COVERED = "array<struct<tag:bigint,starts:array<int>,lengths:array<int>>>"


def removed(text: bytes, n: int, covered: pa.ListScalar | None) -> np.ndarray:
    """Which of the n words of a text stand in a covered window. covered: ranges; null: none."""
    gone = np.zeros(n + 1, np.int64)
    if covered is not None and covered.is_valid:
        for part in covered.values:
            if part["tag"].as_py() in (0, tag_of(text)):
                a, m = (part[c].values.to_numpy() for c in ("starts", "lengths"))
                np.add.at(gone, a, 1)
                np.add.at(gone, a + m - 1 + WINDOW, -1)
    return np.cumsum(gone)[:-1] > 0


def with_covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3) -> DataFrame:
    """(row, covered): docs' rows as structs, so that none of their names can clash, and the ranges of their covered windows
    (null: none). The documents go through the index in `parts` batches of ascending ids.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.struct("*").alias("row"))
    key = F.col("row").getField(id_col).cast("long")
    ends = _raw(docs, id_col, text_col).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.octet_length("text")).alias("size")).first()
    if ends["lo"] is None:
        return rows.withColumn("covered", F.lit(None).cast(_COVERED))
    index = FingerprintIndex(spark, bits=bits_for(ends["size"] or 0))
    lo, hi, candidates = int(ends["lo"]), int(ends["hi"]), []
    cuts = sorted({lo + (hi - lo + 1) * i // parts for i in range(parts)} | {hi + 1})
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = F.col(id_col).cast("long")
        candidates.append(index.append(docs.filter((own >= a) & (own < b)), id_col, text_col))
    for n in index.runs:
        dropped(spark, f"{index.path}/{n}")
    covered = covered_windows(docs, reduce(DataFrame.unionByName, candidates), index.bits, id_col, text_col)
    dropped(spark, index.path)
    per = covered.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "starts", "lengths")).cast(_COVERED).alias("covered"))
    marked = maybe_member(rows, key, covered)
    some = marked.filter("maybe").select("row", key.alias("doc_id")).join(per, "doc_id", "left").select("row", "covered")
    return some.unionByName(marked.filter("not maybe").select("row", F.lit(None).cast(_COVERED).alias("covered")))


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    Null and empty texts have no words. Texts under 13 words lose nothing; rows that repeat an id count as one
    document; nothing is removed from rows with a null id. Empty table: no row.
    """

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept_sha256:string>")
    def digest(text: pa.Array, covered: pa.Array) -> pa.Array:
        rows = []
        for t, c in zip(utf8(text), covered, strict=True):
            words = (t or b"").split()
            gone = removed(t or b"", len(words), c)
            kept = list(itertools.compress(words, ~gone)) if gone.any() else words
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, r, h = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string())], ["n_words", "n_removed", "kept_sha256"])

    found = with_covered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), parts=parts)
    return found.select("row.doc_id", digest.asNondeterministic()(F.col("row.text"), F.col("covered")).alias("d")).select("doc_id", "d.*")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3) -> DataFrame:
    """docs with the covered words cut out of their texts; what stands between kept words stays as it was.

    Passages left on both sides of a cut are joined by one space. A text that loses all its words goes with its row.
    Other columns stay as they are, whatever their names. Null and empty texts, texts under 13 words and rows with a null
    id stay as they are; rows that repeat an id count as one document, and none of them loses words to another. Empty
    table: no row.
    """

    @F.arrow_udf("string")
    def kept(text: pa.Array, covered: pa.Array) -> pa.Array:
        return pa.array([cut(t, c) if t is not None and c.is_valid else t for t, c in zip(text.to_pylist(), covered, strict=True)], pa.string())

    found = with_covered(docs, id_col, text_col, parts)
    text = F.col("row").getField(text_col)
    got = found.select("row", "covered", kept.asNondeterministic()(text, F.col("covered")).alias("kept")).filter(F.col("covered").isNull() | text.isNull() | (F.col("kept") != "") | (text == ""))
    return got.select(*((F.when(F.col("covered").isNull(), text).otherwise(F.col("kept")) if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))


def cut(text: str, covered: pa.ListScalar) -> str:
    """The text without its covered words."""
    raw = text.encode()
    words = raw.split()
    gone = removed(raw, len(words), covered)
    if not gone.any():
        return text
    spans, at = [], 0
    for word, out in zip(words, gone.tolist(), strict=True):
        at = raw.index(word, at)
        if not out:
            if spans and spans[-1][2]:
                spans[-1][1] = at + len(word)
            else:
                spans.append([at, at + len(word), True])
        elif spans:
            spans[-1][2] = False
        at += len(word)
    return b" ".join(raw[a:b] for a, b, _ in spans).decode()
