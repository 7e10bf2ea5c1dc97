"""Commit logs: the next offset of each source partition, what lies before it, and cuts into transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import INT
from ..functions.utils import small


def next_offsets(rows: DataFrame, partition: list[str], offset: str = "off") -> DataFrame:
    """The watermark of each partition: one beyond its highest offset."""
    return rows.groupBy(*partition).agg((F.max(offset) + 1).cast("long").alias("next_offset"))


def watermark(log: DataFrame, topic: str, partition: int) -> DataFrame:
    """One row: the last value of a (topic, partition), -1 if there is none."""
    own = log.where((F.col("topic") == topic) & (F.col("partition") == partition))
    return own.agg(F.coalesce(F.max("next_offset"), F.lit(-1)).cast("long").alias("next_offset"))


def fresh(rows: DataFrame, log: DataFrame, partition: list[str], offset: str = "off") -> DataFrame:
    """Rows that are not done yet: with an offset at or beyond their partition's watermark. The log has a row a partition; it is broadcast where it
    is known to be small."""
    marks = log.select(*partition, F.col("next_offset").alias("_mark"))
    return rows.join(F.broadcast(marks) if small(marks) else marks, partition, "left").where(F.col(offset) >= F.coalesce("_mark", F.lit(-1))).drop("_mark")


def transactions(rows: DataFrame, partition: str, offset: str = "off", size: int = 1_000) -> DataFrame:
    """A model of the size cut: each partition's rows in runs of `size`, and the offset that each run commits."""
    out = rows.groupBy(partition, F.floor(F.col(offset) / size).cast("long").alias("txn"))
    return out.agg(F.count("*").alias("n"), (F.max(offset) + 1).cast("long").alias("commit_off"))


def as_records(log: DataFrame, partitions: int) -> DataFrame:
    """Commit-log records: key, the partition's bytes and the topic; value, the next offset; where they go."""
    key: Column = F.concat(INT.encode(F.col("partition").cast("long")), F.encode("topic", "UTF-8"))
    return log.select(key.alias("key"), INT.encode(F.col("next_offset")).alias("value"), F.pmod("partition", F.lit(partitions)).cast("int").alias("target"))


def starting_offsets(log: DataFrame) -> dict[str, dict[str, int]]:
    """For the connector's startingOffsets: where to go on, for partitions that have a watermark above 0."""
    out: dict[str, dict[str, int]] = {}
    for r in log.where("next_offset > 0").select("topic", "partition", "next_offset").collect():
        out.setdefault(r.topic, {})[str(r.partition)] = r.next_offset
    return out
