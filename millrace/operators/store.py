"""Keyed state as tables: upserts and deletions by key, replay and compaction of a change log, lookups, scans, heaps, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.utils import small
from ..sources.envelope import BLOCK


def latest(rows: DataFrame, keys: list[str], order: str, carry: list[str]) -> DataFrame:
    """Each key's last row. max_by has a partial form, so a hot key costs a row for each task; a window would sort it in one."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*carry), order).alias("_s"))
    return top.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in carry])


def compact(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """What log compaction leaves: the last entry of each key; deletions stay, as nulls."""
    return latest(log, keys, order, [order, value])


def replay(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The store that a change log stands for: upserts apply, an entry without value deletes."""
    return compact(log, keys, order, value).where(F.col(value).isNotNull())


def live(rows: DataFrame, keys: list[str], order: str, deleted: Column, carry: list[str]) -> DataFrame:
    """The store after all rows, where rows for which `deleted` holds take their key out."""
    marked = rows.withColumn("_gone", deleted)
    return latest(marked, keys, order, [*carry, "_gone"]).where(~F.col("_gone")).drop("_gone")


def deletions(rows: DataFrame, key: str, order: str, deleted: Column) -> DataFrame:
    """Rows that delete a key which is there: the ones that leave a tombstone. A key is there after an upsert."""
    gone = last_before(rows.withColumn("_gone", deleted), key, order, F.col("_gone"), "_before")
    return gone.where(F.col("_gone") & ~F.coalesce("_before", F.lit(True))).drop("_gone", "_before")


def last_before(rows: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """A lookup of the store as each row finds it: the last non-null `value` of its key in rows before it, in the order of an integer column.

    A window over a whole key would put a hot key into one task. Here windows are over blocks of the order, and each block starts with
    what the blocks before it leave, a row for a block; windows and join share one exchange. A null key is a key.
    """
    rows = rows.withColumns({"_k": F.struct(key), "_block": F.floor(F.col(order) / block), "_v": value})
    last = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy("_k", "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_e"))
    ends = ends.select("_k", "_block", last("_e", Window.partitionBy("_k").orderBy("_block")).alias("_c"))
    inside = rows.withColumn("_in", last("_v", Window.partitionBy("_k", "_block").orderBy(order)))
    return inside.join(ends, ["_k", "_block"]).withColumn(name, F.coalesce("_in", "_c")).drop("_k", "_block", "_v", "_in", "_c")


def scan(rows: DataFrame, key: str, low, high) -> DataFrame:
    """Keys from low up to, and without, high. The bounds reach the file scan."""
    return rows.where((F.col(key) >= low) & (F.col(key) < high))


def ends(rows: DataFrame, group: str, order: list[str], k: int, carry: list[str]) -> DataFrame:
    """The k least and k greatest rows of each group, with `side`: a double-ended heap's content at both ends. A row at both
    ends is told of once, as one of the least. Each end is a ranked window that keeps k rows a task before the exchange."""
    low = Window.partitionBy(group).orderBy(*[F.col(c) for c in order])
    high = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    rows = rows.select(group, *carry, *[c for c in order if c not in carry and c != group])
    least = rows.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= k).drop("_r").withColumn("side", F.lit("min"))
    most = rows.withColumn("_r", F.row_number().over(high)).where(F.col("_r") <= k).drop("_r").withColumn("side", F.lit("max"))
    only = most.join(least.select(group, *order), [group, *order], "left_anti")
    return least.select(group, *carry, "side").union(only.select(group, *carry, "side"))


def live_counts(rows: DataFrame, partition: str, key: str, order: str, tick: Column, deleted: Column) -> DataFrame:
    """(partition, tick, live_keys): how many keys the store holds at the end of each tick that has rows."""
    state = F.when(deleted, 0).otherwise(1)
    marked = rows.select(partition, F.struct(partition, key).alias("_item"), order, tick.alias("tick"), state.alias("_live"))
    marked = last_before(marked, "_item", order, F.col("_live"), "_was")
    moves = marked.withColumn("_d", F.col("_live") - F.coalesce("_was", F.lit(0))).groupBy(partition, "tick").agg(F.sum("_d").alias("_d"))
    return moves.select(partition, "tick", F.sum("_d").over(Window.partitionBy(partition).orderBy("tick")).cast("long").alias("live_keys"))


def sharded(rows: DataFrame, shard: Column, order: list[str]) -> DataFrame:
    """rows by shard, each shard's rows in order: what a tree for each shard holds."""
    return rows.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", *order)


def shard_sizes(rows: DataFrame, shard: Column) -> DataFrame:
    return rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))


def lookup_global(rows: DataFrame, table: DataFrame, on: Column) -> DataFrame:
    """rows joined to a table that every host holds: broadcast where it is known to be small, by its files or as the optimizer reckons, and
    otherwise left to adaptive execution. Nothing is run to find out."""
    return rows.join(F.broadcast(table) if small(table) else table, on)
