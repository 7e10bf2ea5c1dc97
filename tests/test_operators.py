import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.operators import asynchronous, commitlog, partitioning, routing, store, timers
from millrace.sources import envelope
from millrace.sources.config import Cluster, Destination, EosConfig, ErrorResponse, ManagedCluster, SourceConfig


def test_insert_and_delete(spark):
    """10 000 keys over 10 partitions; then key 0 goes; then all go."""
    rows = spark.range(10_000).selectExpr("id key", "id value", "cast(id % 10 as int) part", "0 gone", "id seq")
    assert {r.n for r in store.live(rows, ["part", "key"], "seq", F.col("gone") == 1, ["value"]).groupBy("part").agg(F.count("*").alias("n")).collect()} == {1000}
    one = rows.union(spark.sql("SELECT 0L, 0L, 0, 1, 20000L"))
    left = store.live(one, ["part", "key"], "seq", F.col("gone") == 1, ["value"])
    assert left.where("part = 0").count() == 999 and left.where("key <> value").count() == 0
    every = rows.union(rows.selectExpr("key", "value", "part", "1", "seq + 20000"))
    assert store.live(every, ["part", "key"], "seq", F.col("gone") == 1, ["value"]).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=30))
def test_replay_of_compacted_log_is_the_store(spark, ops):
    log = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(ops)], "seq long, key int, value int")
    want = {}
    for k, v in ops:
        want.pop(k, None) if v is None else want.__setitem__(k, v)
    once = store.replay(log, ["key"], "seq", "value")
    twice = store.replay(store.compact(log, ["key"], "seq", "value"), ["key"], "seq", "value")
    assert {r.key: r.value for r in once.collect()} == {r.key: r.value for r in twice.collect()} == want


def test_dense_offsets_over_blocks(spark):
    rows = spark.range(0, 5000, 3).selectExpr("id event_id", "cast(id % 7 as int) part")
    got = envelope.dense_offsets(rows, "part", "event_id", block=100)
    bad = got.groupBy("part").agg(F.min("off").alias("lo"), F.max("off").alias("hi"), F.count_distinct("off").alias("n"), F.count("*").alias("c")).where("lo <> 0 or hi <> n - 1 or n <> c")
    assert bad.count() == 0
    assert [r.event_id for r in got.where("part = 3").orderBy("off").collect()] == sorted(r.event_id for r in rows.where("part = 3").collect())


def test_routing_policies(spark):
    df = spark.createDataFrame([(1, "a", '{"k":1}'), (2, "a", "{"), (3, "zz", "x"), (4, None, "x")], "id int, record_type string, value string")
    decode = codecs.json_codec("k int").decode
    out = lambda rows: rows.select("id")
    done, dead = routing.Router().register("a", decode, out).split(df)
    assert [r.id for r in done.collect()] == [1] and sorted(r.id for r in dead.collect()) == [2, 3, 4]
    strict = routing.Router(on_decode_error=lambda e: ErrorResponse.FAIL_CONSUMER).register("a", decode, out)
    with pytest.raises(Exception, match="did not decode"):
        strict.split(df)[0].collect()
    done, dead = routing.Router().register("a", decode, out).register_default(out).split(df)
    assert sorted(r.id for r in done.collect()) == [1, 3, 4]


def test_commit_log(spark):
    rows = spark.createDataFrame([("t", 0, 4), ("t", 0, 9), ("u", 0, 1)], "topic string, partition int, off long")
    log = commitlog.next_offsets(rows, ["topic", "partition"])
    assert commitlog.watermark(log, "t", 0).first()[0] == 10 and commitlog.watermark(log, "u", 0).first()[0] == 2
    assert commitlog.watermark(log, "t", 5).first()[0] == -1
    again = spark.createDataFrame([("t", 0, 9), ("t", 0, 10), ("u", 0, 2), ("v", 3, 0)], "topic string, partition int, off long")
    assert sorted((r.topic, r.off) for r in commitlog.fresh(again, log, ["topic", "partition"]).collect()) == [("t", 10), ("u", 2), ("v", 0)]
    assert commitlog.starting_offsets(log) == {"t": {"0": 10}, "u": {"0": 2}}


def test_partitioner(spark):
    df = spark.createDataFrame([(11, "A"), (None, "A"), (None, "B"), (-1, "UNKNOWN")], "manual int, topic string")
    c = partitioning.target(F.col("manual"), 10, hashed=F.lit(10), topic=F.col("topic"), by_topic={"A": F.lit(1), "B": F.lit(2)})
    assert [r.p for r in df.select(c.alias("p")).collect()] == [11, 1, 2, 10]


def test_heap_ends(spark):
    values = random.Random(3).choices(range(100), k=200)
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "g int, id int, v int")
    got = store.ends(df, "g", ["v", "id"], 5, ["id", "v"]).collect()
    order = sorted(range(200), key=lambda i: (values[i], i))
    assert {r.id for r in got if r.side == "min"} == set(order[:5]) and {r.id for r in got if r.side == "max"} == set(order[-5:])
    few = store.ends(df.limit(3), "g", ["v", "id"], 5, ["id", "v"])
    assert few.count() == 3


def test_keyed_work_is_in_order(spark):
    rows = spark.range(20_000).selectExpr("id % 100 key", "id value")

    def work(p):
        return pd.DataFrame({"key": p["key"], "value": p["value"], "ok": p["value"].diff().fillna(1) > 0})

    got = asynchronous.keyed(rows, "key", "value", work, "key long, value long, ok boolean", asynchronous.SchedulerConfig(4, 10, 100))
    assert got.count() == 20_000 and got.where("not ok").count() == 0
    with pytest.raises(ValueError):
        asynchronous.SchedulerConfig(4, 10, 3)


def test_batches(spark):
    rows = spark.range(20).selectExpr("1 key", "id value").coalesce(1)
    out = asynchronous.in_batches(rows, 10, lambda b: pd.DataFrame({"n": [len(b)], "first": [b["value"].min()], "data": [str((-b["value"]).tolist())]}), "n int, first long, data string")
    assert [(r.n, r.first) for r in out.collect()] == [(10, 0), (10, 10)]
    events = spark.sql("SELECT 1 e, array(1, 2, 3) xs UNION ALL SELECT 2, array() UNION ALL SELECT 3, NULL")
    done = asynchronous.completed(asynchronous.items_of(events, "e", "xs"), "e", F.col("item") == 2)
    assert sorted(tuple(r) for r in done.collect()) == [(1, 3, 1), (2, 0, 0), (3, 0, 0)]


def test_jitter():
    r = random.Random(1)
    due = [timers.next_due(1000, 100, 20, r) for _ in range(500)]
    assert min(due) >= 1080 and max(due) <= 1120 and len(set(due)) > 10
    assert timers.next_due(1000, 100) == 1100


def test_configuration():
    c = SourceConfig("g", "t", Cluster(("h:1", "h:2")))
    assert c.changelog == "gkes_change_log_t_g" and c.kafka_options()["maxOffsetsPerTrigger"] == "30000"
    assert c.resolved({"t": 7}).num_partitions == 7
    with pytest.raises(ValueError):
        c.resolved({"t": 7, c.changelog: 3})
    for bad in (lambda: SourceConfig("", "t"), lambda: SourceConfig("g", ""), lambda: EosConfig(pool_size=0), lambda: EosConfig(batch_delay_ms=0), lambda: EosConfig(target_batch=10, max_batch=5), lambda: Cluster(()).config()):
        with pytest.raises(ValueError):
            bad()
    assert Destination("out", Cluster(("h:1",))).kafka_options()["topic"] == "out" == c.as_destination().__class__("out").default_topic


def test_managed_cluster():
    calls = []

    def lookup(name):
        calls.append(name)
        if len(calls) == 1:
            raise OSError("down")
        return {"tls": "a:1,b:2", "sasl_iam": None}

    c = ManagedCluster("x", "tls", lookup)
    with pytest.raises(OSError):
        c.config()
    assert c.config() == c.config() and c.config()["kafka.security.protocol"] == "SSL" and len(calls) == 2
    with pytest.raises(LookupError):
        ManagedCluster("x", "sasl_iam", lookup).config()
    with pytest.raises(ValueError):
        ManagedCluster("x", "nothing", lookup)


def test_retries(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("c", 3, 0), ("d", 1, 950)], "key string, attempts int, failed_at long")
    due, gone = asynchronous.retries(df, 1000, 600, 3)
    assert [r.key for r in due.collect()] == ["a"] and [r.key for r in gone.collect()] == ["c"]


def test_produce_batch(spark):
    from millrace.streaming.sinks import produce_batch

    events = spark.sql("SELECT 1 e, array(1, 2, 3) xs UNION ALL SELECT 2, array()")
    items = asynchronous.items_of(events, "e", "xs")
    done = produce_batch(items, "e", lambda d: d.withColumn("error", F.when(F.col("item") == 3, "lost")))
    assert sorted(tuple(r) for r in done.collect()) == [(1, 3, 1), (2, 0, 0)]


def test_hot_keys_go_by_blocks(spark):
    """Prefixes of a key over many blocks, with gaps, and of rows without key."""
    import random

    from millrace.operators import asynchronous, store
    from millrace.sources import envelope

    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, None]), i * rng.choice([1, 1]) + (500 if i > 60 else 0), rng.choice([None, rng.randrange(9)]), rng.random() < 0.4) for i in range(120)]
    rows = spark.createDataFrame(data, "k int, i long, v int, gone boolean")
    last, was, seen, found, dead, place = {}, {}, {}, {}, set(), {}
    for k, i, v, gone in data:
        found[i] = last.get(k)
        if v is not None:
            last[k] = v
        if gone and was.get(k) is False:
            dead.add(i)
        was[k] = gone
        seen[k] = place[i] = seen.get(k, 0) + 1
    for block in (7, 50, 10**6):
        assert {r.i: r.x for r in store.last_before(rows, "k", "i", F.col("v"), "x", block).collect()} == found
        own = envelope.dense_offsets(rows.withColumn("_k", F.struct("k")), "_k", "i", "n", block)
        assert {r.i: r.n + 1 for r in own.collect()} == place
    assert {r.i for r in store.deletions(rows, "k", "i", F.col("gone")).collect()} == dead
    assert {r.i: r.seq for r in asynchronous.numbered(rows, "k", "i").collect()} == place
    plan = store.last_before(rows, "k", "i", F.col("v"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k" in plan and "_block" in plan
