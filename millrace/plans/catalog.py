"""The registered queries: each operator over the test tables, and the same in DuckDB SQL.

The events table is the topic: key user_id, partition user_id % 10, offset the rank of event_id in its partition, type event_type;
an `error` event is a deletion.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, hashing, records, utils
from ..operators import asynchronous, commitlog, partitioning, routing, store, timers
from ..sources import envelope
from . import hash_sql, streams

PARTITIONS = 10
QUERIES: dict = {}
SQL: dict[str, str] = {}
_ENV = """WITH env AS (SELECT CAST(user_id % 10 AS INT) AS part, user_id, event_id, event_type, ts, value, props,
  CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS BIGINT) AS off FROM events)"""


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("part", (F.col("user_id") % PARTITIONS).cast("int"))


def _error():
    return F.col("event_type") == "error"


@_query(f"{_ENV} SELECT part, off, user_id, event_type, ts FROM env")
def envelope_rows(spark, d):
    """Every record with its partition and offset."""
    return envelope.from_events(spark, d).select("part", "off", "user_id", "event_type", "ts")


@_query("SELECT event_id, event_type AS record_type, CAST(user_id AS VARCHAR) AS first_key, CAST(2 AS INTEGER) AS n_headers FROM events")
def record_fields(spark, d):
    """Headers of each record: the first of a name, and the type, which is the last type header."""
    heads = F.array(records.header("k", F.col("user_id").cast("string"))).cast(envelope.HEADERS)
    rows = _events(spark, d).withColumn("headers", heads)
    rows = rows.withColumn("headers", records.stamp_type(F.col("event_type")))
    return rows.select("event_id", records.record_type().alias("record_type"), F.decode(records.header_value("k"), "UTF-8").alias("first_key"), F.size("headers").alias("n_headers"))


@_query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def marker_filter(spark, d):
    """Synchronisation marks, here on every third record, are skipped."""
    mark = F.array(records.header(records.MARK_HEADER, F.lit("m")))
    kind = F.array(records.header(records.TYPE_HEADER, F.col("event_type")))
    rows = _events(spark, d).withColumn("headers", F.when(F.col("event_id") % 3 == 0, mark).otherwise(kind))
    return rows.where(~records.is_marker()).select("event_id")


@_query("SELECT CASE WHEN event_type IN ('click','view','purchase') THEN event_type ELSE 'default' END AS handler, count(*) AS n FROM events GROUP BY 1")
def route(spark, d):
    """How many records go to each handler."""
    r = routing.Router()
    for k in ("click", "view", "purchase"):
        r.register(k, None, lambda rows: rows)
    return _events(spark, d).groupBy(r.label("event_type").alias("handler")).agg(F.count("*").alias("n"))


@_query("""SELECT event_id, event_type AS handler, CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT)
  WHEN event_type = 'view' THEN user_id ELSE -1 END AS result FROM events""")
def route_decoded(spark, d):
    """Records decoded and handled by type; types without a handler go to the default."""
    kind = codecs.json_codec("k bigint")
    out = lambda c: lambda rows: rows.select("event_id", F.col("event_type").alias("handler"), c.cast("long").alias("result"))
    r = routing.Router().register("click", kind.decode, out(F.col("event.k"))).register("view", None, out(F.col("user_id")))
    done, _ = r.register("click", None, out(F.lit(-9))).register_default(out(F.lit(-1))).split(_events(spark, d), "event_type", "props")
    return done


@_query("WITH c AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props,1,3) ELSE props END AS p FROM events) SELECT event_id FROM c WHERE NOT json_valid(p)")
def dead_letter(spark, d):
    """Records that do not decode."""
    rows = _events(spark, d).select("event_id", F.lit("e").alias("kind"), F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("p"))
    return routing.Router().register("e", codecs.json_codec("k bigint").decode, lambda r: r).split(rows, "kind", "p")[1].select("event_id")


@_query("SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def decode_json(spark, d):
    return _events(spark, d).select("event_id", codecs.json_codec("k bigint").decode(F.col("props"))["k"].alias("k"))


@_query("""SELECT event_id, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN NULL
  ELSE '{"user_id":' || CAST(user_id AS VARCHAR) || ',"event_id":' || CAST(event_id AS VARCHAR) || '}' END AS value, event_type AS entry_type FROM events""")
def change_entries(spark, d):
    """The change-log entry of each event: the item as JSON, nothing where it is deleted."""
    value = F.when(~_error(), records.json_value("user_id", "event_id")).otherwise(F.lit(b""))
    rows = _events(spark, d).withColumn("headers", F.array(records.header(records.TYPE_HEADER, F.col("event_type"))))
    return rows.select("event_id", F.decode(records.joined_bytes(F.col("user_id").cast("string")), "UTF-8").alias("key"), F.decode(records.serialised(value), "UTF-8").alias("value"), records.record_type().alias("entry_type"))


@_query("SELECT event_id, user_id AS int_back, event_id - 5000 AS lexo_back, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS lexo_rank FROM events")
def codec_round_trip(spark, d):
    """Integers to bytes and back, and each user's order by the sortable form's bytes."""
    x = F.col("event_id") - 5000
    rows = _events(spark, d).select("event_id", "user_id", codecs.INT.encode(F.col("user_id")).alias("i"), codecs.LEXO.encode(x).alias("x"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("x")).cast("long")
    return rows.select("event_id", codecs.INT.decode(F.col("i")).alias("int_back"), codecs.LEXO.decode(F.col("x")).alias("lexo_back"), rank.alias("lexo_rank"))


@_query("SELECT event_type, CAST(sum(strlen(CAST(user_id AS VARCHAR))+strlen(props)+7+strlen(event_type)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def record_bytes(spark, d):
    """Bytes of the records of each type."""
    rows = _events(spark, d).select("event_type", F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"), F.array(records.header(records.TYPE_HEADER, F.col("event_type"))).alias("headers"))
    return rows.groupBy("event_type").agg(F.sum(records.record_size()).alias("bytes"))


@_query(f"{_ENV}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS rn FROM env) SELECT part, user_id, event_id, value FROM l WHERE rn=1 AND event_type <> 'error'")
def store_final(spark, d):
    """The store after all events. Within a partition, order by identifier is order by offset."""
    return store.live(_events(spark, d), ["part", "user_id"], "event_id", _error(), ["event_id", "value"]).select("part", "user_id", "event_id", "value")


@_query(f"{_ENV}, l AS (SELECT *, row_number() OVER (PARTITION BY part, user_id ORDER BY off DESC) AS rn FROM env) SELECT part, user_id, off, CASE WHEN event_type='error' THEN NULL ELSE value END AS value FROM l WHERE rn=1")
def compaction(spark, d):
    """The compacted change log."""
    log = envelope.from_events(spark, d).withColumn("value", F.when(~_error(), F.col("value")))
    return store.compact(log, ["part", "user_id"], "off", "value")


@_query(f"{_ENV}, l AS (SELECT *, row_number() OVER (PARTITION BY part, user_id ORDER BY off DESC) AS rn FROM env) SELECT part, user_id, off, value FROM l WHERE rn=1 AND event_type <> 'error'")
def changelog_replay(spark, d):
    """The store that the change log restores."""
    log = envelope.from_events(spark, d).withColumn("value", F.when(~_error(), F.col("value")))
    return store.replay(log, ["part", "user_id"], "off", "value")


@_query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)
  WHERE event_type = 'error' AND was IS NOT NULL AND was <> 'error'""")
def tombstones(spark, d):
    """Deletions that found their key."""
    return store.deletions(_events(spark, d), "user_id", "event_id", _error()).select("event_id")


@_query("SELECT event_id, user_id, max(CASE WHEN event_type='view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events")
def lookup(spark, d):
    """What a handler finds in the store for its key: the last view before this event."""
    rows = store.last_before(_events(spark, d), "user_id", "event_id", F.when(F.col("event_type") == "view", F.col("event_id")), "last_view")
    return rows.select("event_id", "user_id", "last_view")


@_query("SELECT user_id, max(value) AS v FROM events WHERE user_id >= 5 AND user_id < 12 GROUP BY 1")
def scan(spark, d):
    """A range of keys."""
    return store.scan(spark.read.parquet(f"{d}/events.parquet"), "user_id", 5, 12).groupBy("user_id").agg(F.max("value").alias("v"))


@_query("""WITH r AS (SELECT CAST(user_id % 10 AS INT) AS part, event_id, value, row_number() OVER (PARTITION BY user_id % 10 ORDER BY value, event_id) AS lo,
  row_number() OVER (PARTITION BY user_id % 10 ORDER BY value DESC, event_id DESC) AS hi FROM events)
  SELECT part, event_id, value, CASE WHEN lo<=3 THEN 'min' ELSE 'max' END AS side FROM r WHERE lo<=3 OR hi<=3""")
def minmax(spark, d):
    """Both ends of a heap for each partition."""
    return store.ends(_events(spark, d), "part", ["value", "event_id"], 3, ["event_id", "value"])


@_query("SELECT CAST(user_id % 32 AS INTEGER) AS shard, count(*) AS n FROM events GROUP BY 1")
def shard_counts(spark, d):
    """Sizes of the shards of a tree, by a hash of one's own."""
    return store.shard_sizes(_events(spark, d), (F.col("user_id") % 32).cast("int"))


@_query(f"{_ENV}, op AS (SELECT part, date_trunc('day', ts) AS tick, CASE WHEN event_type='error' THEN 0 ELSE 1 END AS live, coalesce(lag(CASE WHEN event_type='error' THEN 0 ELSE 1 END) OVER (PARTITION BY part, user_id ORDER BY off),0) AS prev FROM env), d AS (SELECT part, tick, sum(live-prev) AS delta FROM op GROUP BY 1,2) SELECT part, CAST(tick AS TIMESTAMP) AS tick, CAST(sum(delta) OVER (PARTITION BY part ORDER BY tick) AS BIGINT) AS live_keys FROM d")
def store_count_asof(spark, d):
    """Live keys of each partition at each day's end."""
    return store.live_counts(_events(spark, d), "part", "user_id", "event_id", F.date_trunc("day", "ts").cast("timestamp_ntz"), _error())


@_query("SELECT r.r_name AS region, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey GROUP BY 1")
def global_table(spark, d):
    """Tables that every host holds, joined to a large one."""
    c, n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation", "region"))
    places = store.lookup_global(n, r, n.n_regionkey == r.r_regionkey)
    rows = store.lookup_global(c, places, c.c_nationkey == places.n_nationkey)
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))


@_query(f"{_ENV} SELECT part, CAST(max(off)+1 AS BIGINT) AS next_offset FROM env GROUP BY part")
def watermark(spark, d):
    """Each partition's next offset."""
    return commitlog.next_offsets(envelope.from_events(spark, d), ["part"])


@_query(f"{_ENV}, w AS (SELECT part, CAST(floor(count(*)/2) AS BIGINT) AS wm FROM env GROUP BY part) SELECT e.part, e.off, e.event_id FROM env e JOIN w ON e.part = w.part WHERE e.off >= w.wm")
def stale_filter(spark, d):
    """What is left to do when the first half of each partition is done."""
    done = _events(spark, d).groupBy("part").agg(F.floor(F.count("*") / 2).cast("long").alias("next_offset"))
    return commitlog.fresh(envelope.from_events(spark, d), done, ["part"]).select("part", "off", "event_id")


@_query(f"{_ENV} SELECT part, CAST(floor(off/1000) AS BIGINT) AS txn, count(*) AS n, CAST(max(off)+1 AS BIGINT) AS commit_off FROM env GROUP BY 1,2")
def txn(spark, d):
    """Transactions of at most 1000 records."""
    return commitlog.transactions(envelope.from_events(spark, d), "part")


@_query("SELECT CAST(user_id % 10 AS INTEGER) AS part, CAST((user_id % 10) % 5 AS INTEGER) AS target, CAST(count(*) AS BIGINT) AS next_back FROM events GROUP BY 1, 2")
def commit_records(spark, d):
    """Commit-log records as bytes, read back."""
    log = commitlog.next_offsets(envelope.from_events(spark, d).withColumn("partition", F.col("part")), ["partition"]).withColumn("topic", F.lit("events"))
    r = commitlog.as_records(log, 5)
    return r.select(codecs.INT32.decode(F.substring("key", 1, 8)).alias("part"), "target", codecs.INT.decode(F.col("value")).alias("next_back"))


@_query("SELECT event_id, CAST(coalesce(CASE WHEN event_type='error' THEN 0 END, user_id % 10) AS BIGINT) AS target FROM events")
def partitioner(spark, d):
    """A partition by hand, else by key."""
    manual = F.when(_error(), F.lit(0)).otherwise(F.lit(partitioning.AUTO))
    return _events(spark, d).select("event_id", partitioning.target(manual, PARTITIONS, hashed=F.col("user_id") % 10).cast("long").alias("target"))


@_query("SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 10 END AS INTEGER) AS target FROM events")
def topic_partitioner(spark, d):
    """A rule for each topic, here the event type."""
    rules = {"click": F.lit(1), "view": F.lit(2)}
    return _events(spark, d).select("event_id", partitioning.target(F.lit(None).cast("int"), PARTITIONS, hashed=F.lit(10), topic=F.col("event_type"), by_topic=rules).alias("target"))


@_query(hash_sql.partitions_and_shards(PARTITIONS, 32))
def murmur2_partitions(spark, d):
    """The partition that producers give to each user's key, and the shard that holds it."""
    key = F.encode(F.col("user_id").cast("string"), "UTF-8")
    users = _events(spark, d).select("user_id").distinct()
    return users.select("user_id", hashing.murmur2_partition(key, PARTITIONS).alias("partition"), hashing.shard_of(key, 4).alias("shard"))


@_query("SELECT CAST(user_id % 10 AS INT) AS part, date_trunc('hour', ts)::TIMESTAMP AS tick, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY 1, 2")
def interjection(spark, d):
    """A timer's view: each partition at each hour."""
    return timers.ticks(_events(spark, d), "part", "ts", "hour", n=F.count("*"), keys=F.count_distinct("user_id"))


@_query(f"{_ENV}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC) AS rn FROM env), s AS (SELECT * FROM l WHERE rn = 1 AND event_type <> 'error') SELECT CAST(p AS INTEGER) AS part, count(user_id) AS live_keys, max(value) AS top FROM range(10) r(p) LEFT JOIN s ON s.part = p GROUP BY 1")
def ask_all(spark, d):
    """A question put to every partition's store."""
    out = timers.ask_all(store_final(spark, d), "part", PARTITIONS, live_keys=F.count("user_id"), top=F.max("value"))
    return out.withColumn("live_keys", F.coalesce("live_keys", F.lit(0)).cast("long"))


@_query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq FROM events")
def key_order(spark, d):
    """The order in which keyed work runs."""
    return asynchronous.numbered(_events(spark, d), "user_id", "event_id").select("user_id", "event_id", "seq")


@_query("""SELECT event_id, user_id, value * 2 AS result, CAST(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS since FROM events""")
def async_keyed(spark, d):
    """Keyed work, run in order for each key: `since` is what the work before it left, and is wrong in any other order."""
    before: dict[int, int] = {}

    def work(p):
        key, ids = int(p["user_id"].iloc[0]), p["event_id"].tolist()
        since = [None if b is None else i - b for b, i in zip([before.get(key), *ids], ids, strict=False)]
        before[key] = ids[-1]
        return p.assign(result=p["value"] * 2, since=pd.array(since, dtype="Int64"))[["event_id", "user_id", "result", "since"]]

    rows = _events(spark, d).select("event_id", "user_id", "value")
    return asynchronous.keyed(rows, "user_id", "event_id", work, "event_id long, user_id long, result double, since long")


@_query("WITH b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) SELECT user_id, CAST(floor(seq/10) AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM b GROUP BY 1,2")
def batcher(spark, d):
    """Items in batches of ten, in order within each key."""
    rows = asynchronous.batches(_events(spark, d), "user_id", "event_id", 10)
    return rows.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@_query("SELECT event_id, -value AS user_data FROM events")
def async_batcher(spark, d):
    """Items across keys, executed at most ten at a time."""
    rows = _events(spark, d).select("event_id", "value")
    return asynchronous.in_batches(rows, 10, lambda b: b.assign(user_data=-b["value"])[["event_id", "user_data"]], "event_id long, user_data double")


@_query("""SELECT o_orderkey AS order_id, CAST(count(l_orderkey) AS BIGINT) AS items, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS failures
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def batch_items(spark, d):
    """Orders as events of items; a callback is due for each, also for an order without items."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("item_ix"), F.col("l_returnflag").alias("item"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("order_id"))
    items = orders.join(lines, "order_id", "left")  # an order without items keeps a row with nulls
    return asynchronous.completed(items, "order_id", F.col("item") == "R").select("order_id", F.col("items").cast("long").alias("items"), F.col("failures").cast("long").alias("failures"))


@_query("SELECT DISTINCT user_id FROM events WHERE event_type='view' EXCEPT SELECT DISTINCT user_id FROM events WHERE event_type='error' AND value > 40")
def set_except(spark, d):
    """A set less another."""
    e = _events(spark, d)
    return e.where("event_type = 'view'").select("user_id").subtract(e.where(_error() & (F.col("value") > 40)).select("user_id"))


@_query("SELECT DISTINCT CAST(user_id % 10 AS INT) AS partition, event_type AS topic FROM events")
def partition_set(spark, d):
    """The set of (partition, topic) that have records."""
    return _events(spark, d).select(F.col("part").alias("partition"), F.col("event_type").alias("topic")).distinct()


@_query("SELECT event_id, least(value, 10.0::DOUBLE) AS lo, greatest(value, 10.0::DOUBLE) AS hi, abs(value - 10.0::DOUBLE) AS d, least(user_id, event_id, 50) AS min_n, greatest(user_id, event_id, 50) AS max_n FROM events")
def least_greatest(spark, d):
    ten, three = F.lit(10.0), F.array("user_id", "event_id", F.lit(50).cast("long"))
    v = F.col("value")
    return _events(spark, d).select("event_id", utils.smaller(v, ten).alias("lo"), utils.larger(v, ten).alias("hi"), utils.absolute(v - ten).alias("d"), utils.min_n(three).alias("min_n"), utils.max_n(three).alias("max_n"))


QUERIES |= streams.QUERIES
SQL |= streams.SQL
