"""murmur2 and xxHash64 (seed 0) of short keys as plain SQL, to hold the Python forms against."""

from __future__ import annotations

_WORD, _LONG = 1 << 32, 1 << 64
#: Fixed values of the two hashes.
_M, _SEED = 0x5BD1E995, 0x9747B28C
_P1, _P2, _P3, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def _m32(x: str) -> str:
    return f"(({x}) * {_M} % {_WORD})"


def _shifted(x: str, bits: int) -> str:
    return f"xor({x}, ({x}) // {1 << bits})"


def _m64(x: str, by: int) -> str:
    """A product of 64 bits, in halves, as the whole one is beyond the widest integer."""
    low, high = f"(({x}) % {_WORD})", f"(({x}) // {_WORD})"
    return f"(((({low} * {by >> 32} + {high} * {by % _WORD}) % {_WORD}) * {_WORD} + {low} * {by % _WORD}) % {_LONG})"


def _turned(x: str, bits: int) -> str:
    return f"((({x}) * {1 << bits}) % {_LONG} + ({x}) // {1 << (64 - bits)})"


def partitions_and_shards(partitions: int, shards: int) -> str:
    """(user_id, partition, shard) of each user's key, its decimal digits; shards of keys below eight bytes only."""
    word = " + ".join(f"y[4 * i + {j + 1}] * {256**j}" for j in range(4))
    rest = " + ".join(f"coalesce(y[n - n % 4 + {j + 1}], 0) * {256**j}" for j in range(3))
    return f"""WITH u AS (SELECT user_id, CAST(user_id AS VARCHAR) AS s FROM (SELECT DISTINCT user_id FROM events)),
  b AS (SELECT user_id, len(s) AS n, list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)) AS y FROM u),
  w AS (SELECT *, list_transform(range(n // 4), lambda i: {word}) AS words, {rest} AS rest FROM b),
  k AS (SELECT *, list_transform(list_transform(words, lambda x: {_m32("x")}), lambda x: {_m32(_shifted("x", 24))}) AS mixed FROM w),
  h0 AS (SELECT *, list_reduce(list_prepend(xor({_SEED}, n), mixed), lambda h, x: xor({_m32("h")}, x)) AS h FROM k),
  h1 AS (SELECT * REPLACE (CASE WHEN n % 4 = 0 THEN h ELSE {_m32("xor(h, rest)")} END AS h) FROM h0),
  h2 AS (SELECT * REPLACE ({_m32(_shifted("h", 13))} AS h) FROM h1),
  m AS (SELECT user_id, n, y, words, {_shifted("h", 15)} % {_WORD // 2} % {partitions} AS p FROM h2),
  x0 AS (SELECT *, CAST({_P5} AS HUGEINT) + n AS x FROM m),
  x1 AS (SELECT * REPLACE (CASE WHEN n < 4 THEN x ELSE xor(x, {_m64("CAST(words[1] AS HUGEINT)", _P1)}) END AS x) FROM x0),
  x2 AS (SELECT * REPLACE (CASE WHEN n < 4 THEN x ELSE ({_m64(_turned("x", 23), _P2)} + {_P3}) % {_LONG} END AS x) FROM x1),
  x3 AS (SELECT *, list_transform(y[n - n % 4 + 1:], lambda c: {_m64("CAST(c AS HUGEINT)", _P5)}) AS ends FROM x2),
  x4 AS (SELECT * REPLACE (list_reduce(list_prepend(x, ends), lambda a, c: {_m64(_turned("xor(a, c)", 11), _P1)}) AS x) FROM x3),
  x5 AS (SELECT * REPLACE ({_m64(_shifted("x", 33), _P2)} AS x) FROM x4),
  x6 AS (SELECT * REPLACE ({_m64(_shifted("x", 29), _P3)} AS x) FROM x5)
  SELECT user_id, CAST(p AS INTEGER) AS partition, CAST({_shifted("x", 32)} % {shards} AS INTEGER) AS shard FROM x6"""
