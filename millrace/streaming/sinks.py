"""Sinks that take a batch once, however often it is run, and what is read of them: committed batches only.

Each batch's rows are a folder of its own, replaced as a whole. Whether it counts is said by the checkpoint's own log of commits, whose
entries Spark makes by rename after the sink is done: a batch that was written and not committed is not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import latest
from .processor import HELD, OUTPUT

_KINDS = re.compile(r"out=(\w+)$")


def batch_folder(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


class Folder:
    """Names in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def delete(self) -> None:
        self.fs.delete(self.path, True)


def partitions_of(spark: SparkSession, root: str, new: int | None = None) -> int | None:
    """How many partitions the source under root has said that it has; with `new`, it says so if nothing is said yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/partitions-{new}")
    files = Folder(spark, root)
    found = next((int(n[11:]) for n in files.names() if re.fullmatch(r"partitions-\d+", n)), None)
    if found is None and new is not None:
        files.fs.mkdirs(files.path)
        files.fs.create(path, True).close()
    return new if found is None else found


def once(root: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: outputs by kind under root, each batch in its folder. A batch that runs again, after a failure
    between sink and checkpoint, overwrites what it wrote before, so that nothing is there twice; an empty one leaves nothing. `then` gets what was written."""

    def write(df: DataFrame, batch: int) -> None:
        spark, path = df.sparkSession, batch_folder(f"{root}/outputs", batch)
        df.write.mode("overwrite").partitionBy("out").parquet(path)
        folder = Folder(spark, path)
        some = any(_KINDS.match(n) for n in folder.names())
        if not some:
            folder.delete()
        if then:
            then(spark.read.schema(OUTPUT).parquet(path) if some else spark.createDataFrame([], OUTPUT), batch)

    return write


def committed(spark: SparkSession, root: str, checkpoint: str | None = None) -> list[str]:
    """Folders of the batches under root that count. checkpoint: that of the source that wrote them, or the only one under root;
    where there is none, all batches count."""
    if checkpoint is None:
        found = [f"{root}/checkpoints/{g}/{t}" for g in Folder(spark, f"{root}/checkpoints").names() for t in Folder(spark, f"{root}/checkpoints/{g}").names() if not g.startswith(".") and not t.startswith(".")]
        if len(found) > 1:
            raise ValueError(f"{root} has several checkpoints: name one")
        checkpoint = found[0] if found else None
    batches = sorted(int(n[6:]) for n in Folder(spark, f"{root}/outputs").names() if re.fullmatch(r"batch=\d+", n))
    if checkpoint is not None:
        # Old entries are cleaned away; batches are committed in order.
        last = max((int(n) for n in Folder(spark, f"{checkpoint}/commits").names() if n.isdigit()), default=-1)
        batches = [b for b in batches if b <= last]
    return [batch_folder(f"{root}/outputs", b) for b in batches]


def outputs(spark: SparkSession, root: str, kind: str, checkpoint: str | None = None) -> DataFrame:
    """All committed rows of a kind: forward, changelog, dead_letter, job or commit; batch is a column. Of a compacted change log these are
    the entries since the last snapshot (changelog has all)."""
    paths = committed(spark, root, checkpoint)
    if not paths:
        return spark.createDataFrame([], f"{OUTPUT}, batch int").where(F.col("out") == kind).drop("out")
    return spark.read.schema(f"{OUTPUT}, batch int").option("basePath", f"{root}/outputs").parquet(*paths).where(F.col("out") == kind).drop("out")


def commits(spark: SparkSession, root: str, checkpoint: str | None = None) -> DataFrame:
    """(topic, partition, next_offset): the commit log that a source's batches hold. All before an offset is done: a record that is
    held stops it. Each group tells how far it is; where groups are keys a partition is as far as its furthest one, or as the first that is
    held."""
    last = latest(outputs(spark, root, "commit", checkpoint), ["topic", "partition", "home"], "seq", ["offset", "record_type"])
    stop = F.min(F.when(F.col("record_type") == HELD, F.col("offset")))
    return last.groupBy("topic", "partition").agg(F.least(stop, F.max("offset")).alias("next_offset"))


def changelog(spark: SparkSession, root: str, checkpoint: str | None = None) -> DataFrame:
    """The entries that the change log under root has: of its last snapshot, where it is compacted, and of the batches since."""
    from .compacted import CompactedLog

    return CompactedLog(spark, root, checkpoint).entries()


def _places() -> list[Column]:
    """Which store an entry is of: a partition's, or a key's, wherever its records came from."""
    return [F.when(F.col("home").isNull(), F.col("partition")).alias("_of"), F.col("home")]


def replayed(spark: SparkSession, root: str, *earlier: str) -> DataFrame:
    """(partition, key, value): the store that the change log under root restores; with `earlier`, the roots whose logs the
    source under root was bootstrapped from, the store of all of them. An entry's place is its number among its
    group's outputs, which goes on from batch to batch: several changes of a key by one record, and changes by timers, which
    have no offset, apply in the order in which they were made. Where groups are keys, partition is that of the last change."""
    log = reduce(DataFrame.unionByName, [changelog(spark, r) for r in (root, *earlier)]).select(*_places(), "partition", "key", "value", "seq")
    last = latest(log, ["_of", "home", "key"], "seq", ["partition", "value"]).where("value is not null")
    return last.select("partition", "key", "value")


def bootstrap(log: DataFrame, marks: DataFrame | None = None, topic: str | None = None) -> DataFrame:
    """The initial state of a new source, from a change log: a row for each item of the store that the log restores, and one
    without item_key for each group, with the number that its outputs go on from and, by partition, its next offset.

    marks has (topic, partition, next_offset), or without topic those of `topic`, as sinks.commits gives them; without marks the new source takes its input from
    the start. Where groups are keys, marks are not part of it: EventSource filters its input by them.
    """
    log = log.select(*_places(), "partition", "key", "value", "record_type", "seq")
    items = latest(log, ["_of", "home", "key"], "seq", ["partition", "value", "record_type"]).where("value is not null")
    ends = log.groupBy("_of", "home").agg((F.max("seq") + 1).alias("seq"), F.max_by("partition", "seq").alias("partition"))
    none = F.lit(None)
    rows = items.select("home", "partition", F.col("key").alias("item_key"), "value", "record_type", none.cast("long").alias("seq"), none.cast("string").alias("topic"), none.cast("long").alias("next_offset"))
    empty = [none.cast("binary"), none.cast("binary"), none.cast("string")]
    rows = rows.union(ends.select("home", "partition", *empty, "seq", none.cast("string"), none.cast("long")))
    if marks is not None:
        named = F.col("topic") if "topic" in marks.columns else F.lit(topic)
        rows = rows.union(marks.select(none.cast("binary"), F.col("partition").cast("int"), *empty, none.cast("long"), named, F.col("next_offset").cast("long")))
    return rows


def produce(df: DataFrame, destination: dict[str, str]) -> None:
    """Write rows to a broker without a transaction; duplicates are possible. Needs Spark's Kafka connector."""
    df.write.format("kafka").options(**destination).save()


def produce_batch(items: DataFrame, event: str, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(event, items, failures) once all records of each event are settled; an event without records is settled at once.

    items has a row a record, with item_ix (null for an event without records). send writes the records, of which some may
    arrive twice if the batch runs again, and returns them with `error`, null where all went well.
    """
    from ..operators.asynchronous import completed

    sent = send(items.where("item_ix is not null"))
    empty = items.where("item_ix is null").withColumn("error", F.lit(None).cast("string"))
    return completed(sent.unionByName(empty, allowMissingColumns=True), event, F.col("error").isNotNull())
