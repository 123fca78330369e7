"""One deterministic pseudo-random primitive: 60 bits of md5 over seed and key, the same in any SQL engine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: str | int, key: Column) -> Column:
    """A bigint in [0, 16**15)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def uniform(seed: str | int, key: Column) -> Column:
    """A double in [0, 1)."""
    return hash_key(seed, key) / F.lit(float(16**15))


def sql_hash(seed: str | int, key: str) -> str:
    """The same in DuckDB's SQL."""
    return f"cast(concat('0x', substr(md5(concat('{seed}|', {key})), 1, 15)) as bigint)"


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's bytes, as a signed long; NULL: NULL. Products wrap, which SQL arithmetic refuses."""

    @F.arrow_udf("bigint")
    def hashed(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            h = 0xCBF29CE484222325
            for b in (t or "").encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            out.append(None if t is None else h - (h >> 63 << 64))
        return pa.array(out, pa.int64())

    return hashed(text)
