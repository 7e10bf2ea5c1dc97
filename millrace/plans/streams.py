"""The registered queries that run on the streaming path: the events as a stream through a source, to its end."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import envelope
from ..sources.config import ExecutionState, SourceConfig
from ..streaming import batching, sinks
from ..streaming.compacted import ENTRY, CompactedLog
from ..streaming.event_source import ROCKSDB, EventSource
from ..streaming.global_table import GlobalTable
from ..streaming.ordered import sortable, unsorted

PARTITIONS = 10
KINDS = ("signup", "view", "click", "purchase", "error")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _run(spark: SparkSession, rows: DataFrame, value: Column, register: Callable[[EventSource], object], by: str = "partition") -> str:
    """The root of a source that has taken all rows: keys are users, types are those of the events."""
    return _source(spark, rows, value, register, by).root


def _source(spark: SparkSession, rows: DataFrame, value: Column, register: Callable[[EventSource], object], by: str = "partition") -> EventSource:
    root = f"{envelope.shared_root(spark)}/millrace/stream-{uuid.uuid4().hex}"
    env = envelope.as_envelope(rows, "events", F.encode(F.col("user_id").cast("string"), "UTF-8"), F.encode(value, "UTF-8"), F.col("event_type"))
    envelope.write_in_order(env, f"{root}/in")
    config = SourceConfig("query-" + uuid.uuid4().hex[:8], "events", num_partitions=PARTITIONS)
    source = EventSource(spark, config, envelope.from_files(spark, f"{root}/in", PARTITIONS), root, by=by)
    register(source)
    source.start(available_now=True).wait()
    source.spark.streams.removeListener(source.metrics)
    if source.error is not None:
        raise source.error
    return source


def _key(ctx) -> bytes:
    return bytes(ctx.input.key)


def _user(c: str = "key") -> Column:
    return F.decode(c, "UTF-8").cast("long")


def _number(at: int) -> Column:
    """The 64-bit integer, greatest byte first, from a byte of the value."""
    return F.conv(F.hex(F.substring("value", at, 8)), 16, 10).cast("long")


def _put(ctx, raw):
    ctx.put(_key(ctx), raw, ctx.input.record_type)


def _delete(ctx, raw):
    ctx.delete(_key(ctx))


@_query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
  SELECT CAST(user_id % 10 AS INT) AS part, user_id, event_id, value FROM l WHERE rn = 1 AND event_type <> 'error'""")
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The store that the change log of a source by partition restores."""
    item = F.when(F.col("event_type") != "error", F.to_json(F.struct("event_id", "value")))

    def register(source):
        for kind in KINDS:
            source.register(kind, lambda raw: raw, _delete if kind == "error" else _put)

    root, value = _run(spark, envelope.from_events(spark, d), item, register), F.decode("value", "UTF-8")
    return sinks.replayed(spark, root).select(
        F.col("partition").alias("part"), _user().alias("user_id"),
        F.get_json_object(value, "$.event_id").cast("long").alias("event_id"), F.get_json_object(value, "$.value").cast("double").alias("value"),
    )


@_query("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def stream_key_sums(spark: SparkSession, d: str) -> DataFrame:
    """A store by key, where a key's records come from all partitions: what the change log restores has counted each record once."""

    def add(ctx, raw):
        n, total = struct.unpack(">qq", ctx.get(_key(ctx)) or bytes(16))
        ctx.put(_key(ctx), struct.pack(">qq", n + 1, total + int(raw)))

    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("part", F.pmod("event_id", F.lit(PARTITIONS)).cast("int"))
    root = _run(spark, envelope.dense_offsets(rows, "part", "event_id"), F.col("event_id").cast("string"), lambda source: source.register_default(add), by="key")
    return sinks.replayed(spark, root).select(_user().alias("user_id"), _number(1).alias("n"), _number(9).alias("total"))


@_query("""WITH p AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS BIGINT) AS off FROM events)
  SELECT CAST(user_id % 10 AS INT) AS part, off, user_id, event_id FROM p WHERE event_type = 'purchase'""")
def stream_forwards(spark: SparkSession, d: str) -> DataFrame:
    """What handlers forwarded, of committed batches."""
    root = _run(spark, envelope.from_events(spark, d), F.col("event_id").cast("string"), lambda source: source.register("purchase", bytes, lambda ctx, raw: ctx.forward("sales", _key(ctx), raw)).register_default(lambda ctx, raw: None))
    return sinks.outputs(spark, root, "forward").select(F.col("partition").alias("part"), F.col("offset").alias("off"), _user().alias("user_id"), F.decode("value", "UTF-8").cast("long").alias("event_id"))


@_query("SELECT 'events' AS topic, CAST(user_id % 10 AS INT) AS part, count(*) AS next_offset FROM events GROUP BY 2")
def stream_commits(spark: SparkSession, d: str) -> DataFrame:
    """The commit log that a source's own batches hold."""
    root = _run(spark, envelope.from_events(spark, d), F.lit(""), lambda source: source.register_default(lambda ctx, raw: None))
    return sinks.commits(spark, root).select("topic", F.col("partition").alias("part"), "next_offset")


@_query("""SELECT user_id, count(*) AS n, CAST(sum(2 * event_id) AS BIGINT) AS total, coalesce(max(CASE WHEN event_type <> 'error' THEN event_id END), 0) AS last_id,
  CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS failed FROM events GROUP BY 1""")
def stream_finalized(spark: SparkSession, d: str) -> DataFrame:
    """Two stages of work outside the store, one after the other; finalizers sum up in the store what comes back, in order for each key,
    and count the errors of the work."""

    def doubled(key: bytes, raw: bytes) -> bytes:
        number, kind = raw.split()
        if kind == b"error":
            raise ValueError(number.decode())
        return b"%d" % (2 * int(number))

    def add(ctx, key, number, failed):
        n, total, last, wrong = struct.unpack(">qqqq", ctx.get(key) or bytes(32))
        if not failed:
            last = number if number >= last else -1  # what comes out of order shows
        ctx.put(key, struct.pack(">qqqq", n + 1, total + 2 * number, last, wrong + failed))

    def first(ctx, key, result, error):
        if error is not None:
            return add(ctx, key, int(error), 1)
        return ctx.schedule("halve", key, result)

    def second(ctx, key, result, error):
        add(ctx, key, int(result), 0)

    def register(source):
        source.register_default(lambda ctx, raw: ctx.schedule("double", _key(ctx), raw))
        source.register_async("double", doubled, first).register_async("halve", lambda key, raw: b"%d" % (int(raw) // 2), second)

    root = _run(spark, envelope.from_events(spark, d), F.concat_ws(" ", "event_id", "event_type"), register)
    return sinks.replayed(spark, root).select(_user().alias("user_id"), _number(1).alias("n"), _number(9).alias("total"), _number(17).alias("last_id"), _number(25).alias("failed"))


@_query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS off FROM events),
  r AS (SELECT event_id, user_id % 4 AS lane, row_number() OVER (PARTITION BY user_id % 4 ORDER BY user_id % 10, off) - 1 AS place FROM p)
  SELECT event_id, CAST(lane AS INT) AS lane, CAST(place // 10 AS BIGINT) AS batch, CAST(place % 10 AS INT) AS place, -event_id AS user_data FROM r""")
def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    """Items of all partitions executed ten at a time, in four lanes; the last of each lane when a delay has passed."""
    root = f"{envelope.shared_root(spark)}/millrace/stream-{uuid.uuid4().hex}"
    rows = envelope.from_events(spark, d)
    rows = rows.select(F.col("part").alias("partition"), F.col("off").alias("offset"), F.col("event_id").alias("event"), F.lit(0).alias("item_ix"), F.lit(1).alias("n_items"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value"))
    rows.write.parquet(f"{root}/in")
    n = spark.read.parquet(f"{root}/in").count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # All files are one batch of the stream, so that lanes fill in the order of partitions and offsets.
    done = batching.in_batches(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), _negated, 10, 500, 4, F.decode("key", "UTF-8").cast("long"))
    query = done.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="200 milliseconds").start()
    try:
        settled = lambda: spark.read.schema(batching.DONE).parquet(f"{root}/out")
        while query.isActive and (query.lastProgress is None or settled().count() < n):
            query.awaitTermination(0.5)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return settled().select(F.col("event").alias("event_id"), "lane", "batch", "place", F.decode("result", "UTF-8").cast("long").alias("user_data"))


def _negated(items: list[tuple[bytes, bytes]]) -> list[bytes]:
    return [b"%d" % -int(v) for _, v in items]


#: What a bounded queue of each partition keeps.
KEPT = 20


@_query(f"""WITH r AS (SELECT CAST(user_id % 10 AS INT) AS part, event_id, CAST(round(value * 1000) AS BIGINT) AS priority, row_number() OVER (PARTITION BY user_id % 10 ORDER BY CAST(round(value * 1000) AS BIGINT) DESC, CAST(event_id AS VARCHAR) DESC) AS k FROM events)
  SELECT part, event_id, priority FROM r WHERE k <= {KEPT}""")
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue with two ends in the state of each partition: every event is pushed, and above KEPT the least is popped."""

    def push(ctx, raw):
        event, priority = raw.split()
        ctx.queue.push(event, int(priority))
        if len(ctx.queue) > KEPT:
            ctx.queue.pop_least()

    value = F.concat_ws(" ", "event_id", F.round(F.col("value") * 1000).cast("long"))
    source = _source(spark, envelope.from_events(spark, d), value, lambda source: source.with_ordered_state(8).register_default(push))
    number = F.conv(F.hex(F.substring("item_key", 2, 8)), 16, 10).cast("long")
    return source.ordered_state().select(F.col("partition").alias("part"), F.decode(F.expr("substring(item_key, 10)"), "UTF-8").cast("long").alias("event_id"), number.alias("priority"))


@_query("""SELECT e.event_id, e.user_id, min(b.user_id) AS next_user FROM events e LEFT JOIN events b
  ON b.user_id % 10 = e.user_id % 10 AND b.event_id < e.event_id AND b.user_id > e.user_id GROUP BY 1, 2""")
def stream_next(spark: SparkSession, d: str) -> DataFrame:
    """Ordered state of each partition: the next user above an event's own that the store has by then."""

    def ask(ctx, raw):
        own = sortable(int(_key(ctx)))
        found = ctx.ordered.next(own)
        ctx.forward("next", _key(ctx), raw + b" " + (b"" if found is None else b"%d" % unsorted(found[0])))
        ctx.ordered.put(own, raw)

    root = _run(spark, envelope.from_events(spark, d), F.col("event_id").cast("string"), lambda source: source.with_ordered_state(16).register_default(ask))
    said = F.split(F.decode("value", "UTF-8"), " ")
    return sinks.outputs(spark, root, "forward").select(said[0].cast("long").alias("event_id"), _user().alias("user_id"), F.when(said[1] != "", said[1]).cast("long").alias("next_user"))


@_query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn,
  bool_or(event_type <> 'error') OVER (PARTITION BY user_id) AS ever FROM events)
  SELECT CAST(user_id % 10 AS INT) AS part, user_id, CASE WHEN event_type <> 'error' THEN event_id END AS event_id FROM l WHERE rn = 1 AND ever""")
def stream_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The files of a compacted change log: one entry of each key that was ever there, null for a deletion."""

    def register(source):
        for kind in KINDS:
            source.register(kind, lambda raw: raw, _delete if kind == "error" else _put)

    root = _run(spark, envelope.from_events(spark, d), F.when(F.col("event_type") != "error", F.col("event_id").cast("string")), register)
    log = CompactedLog(spark, root)
    log.compact()
    return spark.read.schema(ENTRY).parquet(log.manifest().path).select(F.col("of").alias("part"), _user().alias("user_id"), F.decode("value", "UTF-8").cast("long").alias("event_id"))


@_query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
  SELECT o_orderkey, o_custkey, l.event_id FROM orders LEFT JOIN (SELECT * FROM l WHERE rn = 1 AND event_type <> 'error') l ON l.user_id = o_custkey""")
def stream_global(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a stream, joined to a table that follows the change log of the events' source."""

    def register(source):
        for kind in KINDS:
            source.register(kind, lambda raw: raw, _delete if kind == "error" else _put)

    root = _run(spark, envelope.from_events(spark, d), F.when(F.col("event_type") != "error", F.col("event_id").cast("string")), register)
    table = GlobalTable(spark, root, f"{root}/global", lambda store: store.select(_user().alias("o_custkey"), F.decode("value", "UTF-8").cast("long").alias("event_id")))
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    orders.write.parquet(f"{root}/orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{root}/orders")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/joined/batch={batch}")
    stream.writeStream.foreachBatch(table.follow(["o_custkey"], write)).option("checkpointLocation", f"{root}/joined-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/joined").select("o_orderkey", "o_custkey", "event_id")
