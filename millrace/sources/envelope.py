"""The envelope: one schema for every topic, live or at rest."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records

HEADERS = "array<struct<key:string,value:binary>>"
SCHEMA = f"topic string, partition int, offset bigint, leader_epoch int, timestamp timestamp, key binary, value binary, headers {HEADERS}, record_type string"
COLUMNS = [c.split()[0] for c in SCHEMA.replace(HEADERS, "x").split(", ")]
#: Identifiers to a block of offsets (dense_offsets); a bound on what one task sorts.
BLOCK = 1_000_000


def dense_offsets(rows: DataFrame, partition: str, order: str, name: str = "off", block: int = BLOCK) -> DataFrame:
    """rows with `name`: 0, 1, ... in the order of an integer column within each partition.

    A window over whole partitions would put a topic's partition, however long, into one task. Here rows are numbered within
    blocks of identifiers, and each block starts where the counts of those before it end; the table of counts has a
    row for a block. The numbering and the join share one exchange.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = rows.groupBy(partition, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(partition, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(partition, "_block").orderBy(order)) - 1
    return rows.withColumn("_in", inside).join(base, [partition, "_block"]).withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_block", "_base", "_in")


def from_events(spark: SparkSession, sf_dir: str, partitions: int = 10) -> DataFrame:
    """The events table as part, off, user_id, event_id, event_type, ts, value, props (key = user, type = event type)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", (F.col("user_id") % partitions).cast("int"))
    return dense_offsets(events, "part", "event_id").select("part", "off", "user_id", "event_id", "event_type", "ts", "value", "props")


def as_envelope(rows: DataFrame, topic: str, key: Column, value: Column, kind: Column, partition: str = "part", offset: str = "off", ts: str = "ts") -> DataFrame:
    """Rows in the envelope's schema; the type goes into a header and into record_type."""
    heads = F.array(records.header(records.TYPE_HEADER, kind)).cast(HEADERS)
    return rows.select(
        F.lit(topic).alias("topic"), F.col(partition).cast("int").alias("partition"), F.col(offset).cast("long").alias("offset"), F.lit(0).alias("leader_epoch"),
        F.col(ts).cast("timestamp").alias("timestamp"), key.cast("binary").alias("key"), value.cast("binary").alias("value"), heads.alias("headers"), kind.alias("record_type"),
    )


def from_kafka(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """A broker's topic in the envelope's schema. Needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options).option("includeHeaders", "true")
    return reader.load().select("topic", "partition", "offset", F.lit(None).cast("int").alias("leader_epoch"), "timestamp", "key", "value", "headers", records.record_type().alias("record_type"))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one machine may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return root.rstrip("/")


#: Offsets of each partition that go into one file (write_in_order): what a batch of a stream over such files has of a partition.
SLICE = 1_000_000


def write_in_order(rows: DataFrame, path: str, offsets: int = SLICE) -> None:
    """Envelope rows as files that a stream takes in the order of offsets: slice after slice, each partition's slice in one
    file, so that a batch of some files holds a bounded part of a partition and none that comes after a later one.

    Rows are written once, by slice and partition, beside the path; then the files are released into it with times of change that
    follow the slices, as a stream over files goes by them. The driver handles names alone. Object stores that keep no time of change
    of one's own need a name for each release, or from_files with one slice a folder.
    """
    spark, apart = rows.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    sliced = rows.withColumn("_slice", F.floor(F.col("offset") / offsets))
    sliced.repartition("_slice", "partition").sortWithinPartitions("_slice", "partition", "offset").write.partitionBy("_slice").parquet(apart)
    to = spark._jvm.org.apache.hadoop.fs.Path
    files = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(to(path))
    folders = sorted((int(x.getPath().getName()[7:]), x.getPath()) for x in files.listStatus(to(apart)) if x.isDirectory() and x.getPath().getName().startswith("_slice="))
    now = int(time.time() * 1000) - 1000 * len(folders)
    for k, (number, folder) in enumerate(folders):
        for f in files.listStatus(folder):
            name = f.getPath().getName()
            if name.endswith(".parquet"):
                files.setTimes(f.getPath(), now + 1000 * k, -1)
                files.rename(f.getPath(), to(f"{path}/slice-{number:012d}-{name}"))
    files.delete(to(apart), True)


def from_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of envelope rows from a folder of Parquet files."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
