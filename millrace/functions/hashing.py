"""Hashes that Spark does not have, for parity with other producers' partitions and shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = np.uint32(0x5BD1E995)
_SEED = 0x9747B28C


def murmur2(keys: list[bytes | None]) -> np.ndarray:
    """The 32-bit hash that producers place keys by; keys of one length at a time, as columns of words. None counts as empty."""
    out = np.zeros(len(keys), dtype=np.int32)
    by: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by.setdefault(len(k or b""), []).append(i)
    with np.errstate(over="ignore"):
        for n, rows in by.items():
            raw = np.frombuffer(b"".join(keys[i] or b"" for i in rows), np.uint8).reshape(len(rows), n)
            h = np.full(len(rows), _SEED ^ n, dtype=np.uint32)
            whole = n // 4 * 4
            words = np.ascontiguousarray(raw[:, :whole]).view("<u4") if whole else np.empty((len(rows), 0), np.uint32)
            for c in range(words.shape[1]):
                k = words[:, c] * _M
                k ^= k >> np.uint32(24)
                h = h * _M ^ k * _M
            for at in range(n - 1, whole - 1, -1):
                h ^= raw[:, at].astype(np.uint32) << np.uint32(8 * (at - whole))
            if n > whole:
                h *= _M
            h ^= h >> np.uint32(13)
            h *= _M
            h ^= h >> np.uint32(15)
            out[rows] = h.view(np.int32)
    return out


@F.pandas_udf(T.IntegerType())
def murmur2_udf(keys: pd.Series) -> pd.Series:
    return pd.Series(murmur2([None if k is None else bytes(k) for k in keys]))


def murmur2_partition(key: Column, n: int | Column) -> Column:
    """The partition that a producer's default gives to a key of bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    return (murmur2_udf(key.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)) % n).cast("int")


@F.pandas_udf(T.LongType())
def xxhash64_seed0(keys: pd.Series) -> pd.Series:
    """xxHash64 with seed 0 of bytes, as a signed integer (Spark's own has seed 42)."""
    import xxhash

    return pd.Series(np.array([xxhash.xxh64_intdigest(bytes(k)) if k is not None else 0 for k in keys], dtype=np.uint64).view(np.int64))


def shard_of(key: Column, exponent: int) -> Column:
    """The shard, of 2 << exponent, that holds a key."""
    return xxhash64_seed0(key.cast("binary")).bitwiseAND(F.lit((2 << exponent) - 1)).cast("int")
