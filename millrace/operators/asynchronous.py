"""Keyed work outside the state's thread: in order for each key, parallel across keys, alone or in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.envelope import dense_offsets


@dataclass(frozen=True)
class SchedulerConfig:
    """How much runs at once. max_concurrent_keys may not be below concurrency."""

    concurrency: int = 1
    queue_depth: int = 100
    max_concurrent_keys: int = 10_000

    def __post_init__(self):
        if self.concurrency < 1 or self.queue_depth < 0 or self.max_concurrent_keys < self.concurrency:
            raise ValueError("concurrency 1 or more, queue_depth 0 or more, max_concurrent_keys not below concurrency")

    @classmethod
    def preset(cls, kind: str, cores: int) -> SchedulerConfig:
        """compute, fast_network, slow_network or wide_network: so many workers a core."""
        return cls(concurrency={"compute": 1, "fast_network": 4, "slow_network": 16, "wide_network": 32}[kind] * cores)


#: Rows of a frame that goes back from a worker, at least.
RETURNED = 5_000


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for f in frames:
        if len(f):
            held.append(f)
            n += len(f)
        if n >= RETURNED:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def keyed(rows: DataFrame, key: str, order: str | list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, config: SchedulerConfig = SchedulerConfig()) -> DataFrame:
    """work on each key's rows in order: one exchange by key, a sort within tasks, then a stream of keys in which
    up to `concurrency` keys run at a time (threads, for work that waits). work gets some of a key's rows at a time, so a
    hot key needs no more memory than another; the parts of one key come one after the other. At most max_concurrent_keys keys, and
    queue_depth beyond those that run, are open at a time."""
    most = min(config.max_concurrent_keys, config.concurrency + config.queue_depth)
    orders = [order] if isinstance(order, str) else order

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(config.concurrency) as pool:
            for b in batches:
                parts = [g for _, g in b.groupby(key, sort=False, dropna=False)]
                yield from _gathered(done for k in range(0, len(parts), most) for done in pool.map(work, parts[k : k + most]))

    return rows.repartition(key).sortWithinPartitions(key, *orders).mapInPandas(run, schema)


def in_turn(rows: DataFrame, key: str, order: str | list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """keyed() for work on single rows, one at a time: frames are of several keys, each key's rows in order."""
    orders = [order] if isinstance(order, str) else order
    return rows.repartition(key).sortWithinPartitions(key, *orders).mapInPandas(lambda frames: map(work, frames), schema)


def numbered(rows: DataFrame, key: str, order: str, name: str = "seq") -> DataFrame:
    """The place of each row in its key's order, from 1, by an integer column; a hot key is numbered in blocks. A null key is a key."""
    return dense_offsets(rows.withColumn("_key", F.struct(key)), "_key", order, name).withColumn(name, F.col(name) + 1).drop("_key")


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with `batch`: each key's rows in order, `size` at a time. An event of more items goes over several batches."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    return numbered(rows, key, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def in_batches(rows: DataFrame, size: int, execute: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, key: str | None = None, order: str | None = None) -> DataFrame:
    """execute on groups of at most `size` items, across keys. With a key, its items are in one task and in order, so that no two
    batches that hold it run at the same time. Results go back in frames of RETURNED rows or more, as a frame of its own for each
    batch would cost more than the batch."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    if key is not None:
        rows = rows.repartition(key).sortWithinPartitions(key, *([order] if order else []))

    def done(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for f in frames:
            left = f if left is None or not len(left) else pd.concat([left, f], ignore_index=True)
            whole = len(left) // size * size
            for k in range(0, whole, size):
                yield execute(left.iloc[k : k + size].reset_index(drop=True))
            left = left.iloc[whole:]
        if left is not None and len(left):
            yield execute(left.reset_index(drop=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _gathered(done(frames))

    return rows.mapInPandas(run, schema)


def items_of(events: DataFrame, event: str, items: str) -> DataFrame:
    """A row for each item, with its place; an event without items keeps a row with nulls, and so its turn."""
    return events.select("*", F.posexplode_outer(items).alias("item_ix", "item")).drop(items)


def completed(items: DataFrame, event: str, failed: Column) -> DataFrame:
    """(event, items, failures) once every item is settled: when a callback is due, also for an event without items."""
    one = F.when(F.col("item_ix").isNotNull(), 1).otherwise(0)
    return items.groupBy(event).agg(F.sum(one).alias("items"), F.sum(F.when(failed & (one == 1), 1).otherwise(0)).alias("failures"))


def retries(failures: DataFrame, now_ms: int, wait_ms: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(due, given up): of work that failed (attempts, failed_at in ms), what a timer submits again now, after a wait that
    doubles with each attempt, and what has failed `most` times."""
    after = F.col("failed_at") + wait_ms * F.pow(F.lit(2), F.col("attempts") - 1)
    return failures.where((F.col("attempts") < most) & (after <= now_ms)), failures.where(F.col("attempts") >= most)
