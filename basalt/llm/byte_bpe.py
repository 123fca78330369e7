"""Operator 5: byte-level BPE encoding with character offsets, and decoding that reverses the byte table."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .encoding import encoder


def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the characters from U+0100 on.
    """
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteDecoder:
    """Bytes of ids. A token may hold a part of a character; only the joined bytes are UTF-8 again."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_table()
        vocabulary = spec["model"]["vocab"]
        size = 1 + max(vocabulary.values(), default=-1)
        self.bytes: list[bytes] = [b""] * size
        for word, i in vocabulary.items():
            self.bytes[i] = bytes(table[c] for c in word)
        self.width = np.array([len(b) for b in self.bytes] or [0], np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Per token the first character it holds a byte of, and the place after the last one: an (n, 2) array."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        ends = np.cumsum(self.width[ids])
        starts = ends - self.width[ids]
        return np.stack([char[starts], char[ends - 1] + 1], axis=1) if len(ids) else np.zeros((0, 2), np.int64)


    def split(self, text: str, ids: np.ndarray) -> int:
        """How many tokens start inside a character."""
        spans = self.offsets(text, ids)
        return int((spans[1:, 0] < spans[:-1, 1]).sum())

    def texts(self, parts: Iterable[bytes]) -> Iterator[str]:
        """The text of each part of a document's bytes: a character that the parts split comes whole with its last byte. Bytes
        that are no UTF-8 become U+FFFD."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            yield held.decode(part)
        if rest := held.decode(b"", True):
            yield rest


#: Ids that are decoded at a time.
PART = 4096


@lru_cache(maxsize=4)
def decoder(path: str) -> ByteDecoder:
    return ByteDecoder(path)


def ids_column(text: Column, path: str, offsets: bool = False) -> Column:
    """Ids of a text, array<int>; with offsets, struct<ids, starts, ends> in characters. Null: empty."""
    kind = "array<int>"

    @F.arrow_udf(kind if not offsets else f"struct<ids:{kind},starts:{kind},ends:{kind}>")
    def encode(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        got = encoder(path).encode(texts)
        ids = _lists(got)
        if not offsets:
            return ids
        spans = [decoder(path).offsets(t or "", i) for t, i in zip(texts, got, strict=True)]
        return pa.StructArray.from_arrays([ids, _lists([s[:, 0] for s in spans]), _lists([s[:, 1] for s in spans])], ["ids", "starts", "ends"])

    return encode(text)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)), pa.array(flat, pa.int32()))


def string_column(ids: Column, path: str, part: int = PART) -> Column:
    """The decoded text, string, `part` ids at a time. Null: null."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        own = decoder(path)
        return pa.array([None if x is None else "".join(own.texts(own.decode(x[i : i + part]) for i in range(0, len(x), part))) for x in column.to_pylist()], pa.string())

    return decode(ids)


def text_column(ids: Column, path: str) -> Column:
    """The decoded bytes, binary. Null: null."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        back = decoder(path).decode
        return pa.array([None if x is None else back(x) for x in column.to_pylist()], pa.binary())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids[, starts, ends]) per row of docs. A null text has no ids; repeated rows give repeated results."""
    bound_batches(docs.sparkSession)
    got = docs.select(F.col(id_col), ids_column(F.col(text_col), path, offsets).alias("ids"))
    return got.select(id_col, "ids.*") if offsets else got


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_chars, n_split) per row: encode, decode the ids again, digest both.

    n_chars: the characters of the text decoded in parts; n_split: tokens that start inside a character, by the offsets.
    Encoding and decoding share one Arrow pass, so the ids never travel back to the JVM. Null and empty texts have no
    token; repeated rows give repeated results; an empty table gives no row; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,n_chars:bigint,n_split:bigint>")
    def digests(column: pa.Array) -> pa.Array:
        own_decoder = decoder(path)
        names = [str(i) for i in range(len(own_decoder.bytes))]
        rows = []
        texts = column.to_pylist()
        for at in range(0, len(texts), 128):  # the ids of few texts at a time
            some = texts[at : at + 128]
            for text, ids in zip(some, encoder(path).encode(some), strict=True):
                own, digest = ids.tolist(), hashlib.sha256()
                parts = [own_decoder.decode(own[i : i + PART]) for i in range(0, len(own), PART)]
                for part in parts:
                    digest.update(part)
                chars = sum(map(len, own_decoder.texts(parts)))
                split = 0 if (text or "").isascii() else own_decoder.split(text, ids)
                rows.append((len(own), hashlib.sha256(" ".join(map(names.__getitem__, own)).encode()).hexdigest(), digest.hexdigest(), chars, split))
        n, a, b, c, d = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["n_tokens", "ids_sha256", "decoded_sha256", "n_chars", "n_split"])

    return docs.select(F.col(id_col), digests.asNondeterministic()(F.col(text_col)).alias("d")).select(id_col, "d.*")
