"""Interjections over tables: what a timer, or a question put to every partition, sees."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Interjections have no input record and commit nothing.
NO_OFFSET = -1


def ticks(rows: DataFrame, partition: str, ts: str, every: str, **aggregates: Column) -> DataFrame:
    """One row for each partition and tick that has rows. A date_trunc unit; the tick keeps the type of ts."""
    kind = rows.schema[ts].dataType
    return rows.groupBy(partition, F.date_trunc(every, ts).cast(kind).alias("tick")).agg(*[c.alias(n) for n, c in aggregates.items()])


def ask_all(store: DataFrame, partition: str, partitions: int, **aggregates: Column) -> DataFrame:
    """Every partition's answer, in order; a partition with an empty store answers too."""
    every = store.sparkSession.range(partitions).select(F.col("id").cast("int").alias(partition))
    answers = store.groupBy(partition).agg(*[c.alias(n) for n, c in aggregates.items()])
    return every.join(answers, partition, "left").orderBy(partition)


def next_due(now_ms: int, every_ms: int, jitter_ms: int = 0, rng: random.Random | None = None) -> int:
    """When a timer is due again: every_ms from now, more or less by up to jitter_ms. Counted from when the last run ended."""
    if jitter_ms == 0:
        return now_ms + every_ms
    r = rng or random
    step = int(r.random() * jitter_ms)
    return now_ms + max(1, every_ms + (step if r.random() < 0.5 else -step))
