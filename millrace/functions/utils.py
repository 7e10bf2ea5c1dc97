"""Small helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def absolute(x: Column) -> Column:
    return F.abs(x)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def min_n(values: Column) -> Column:
    """The least of an array; 0 of an empty one."""
    return F.coalesce(F.array_min(values), F.lit(0))


def max_n(values: Column) -> Column:
    """The greatest of an array; 0 of an empty one."""
    return F.coalesce(F.array_max(values), F.lit(0))


def map_keys(m: Column) -> Column:
    return F.map_keys(m)


def map_values(m: Column) -> Column:
    return F.map_values(m)


#: Bytes of a table that is broadcast, at most.
BROADCAST_BYTES = 64_000_000


def small(table: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is at most so large by what the optimizer knows of it, from its files or rows at hand; nothing is run."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes
