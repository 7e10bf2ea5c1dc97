"""Compaction of a change log on disk, and a table that follows one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import sinks
from millrace.streaming.compacted import CompactedLog, Manifest
from millrace.streaming.global_table import GlobalTable


class Source:
    """What a source by partition leaves of changes: a batch each time, and the store by hand."""

    def __init__(self, spark, root):
        self.spark, self.root, self.seq, self.batch, self.store = spark, root, 0, 0, {}

    def put(self, changes):
        rows = []
        for part, key, value in changes:
            rows.append(("changelog", "log", part, 0, key.encode(), None if value is None else value.encode(), "x", self.seq, None, "t"))
            self.seq += 1
            self.store.pop((part, key), None)
            if value is not None:
                self.store[part, key] = value
        rows.append(("forward", "f", 0, 0, b"k", b"v", "x", self.seq, None, "t"))
        self.seq += 1
        sinks.once(self.root)(self.spark.createDataFrame(rows, sinks.OUTPUT), self.batch)
        self.batch += 1

    def check(self, df):
        assert {(r.partition, bytes(r.key).decode()): bytes(r.value).decode() for r in df.collect()} == self.store


def test_restored_store_is_the_same_before_and_after(spark, tmp_path):
    rng, root = random.Random(1), str(tmp_path)
    source, log = Source(spark, root), CompactedLog(spark, root)
    assert log.manifest() == Manifest() and not log.compact() and log.restored().count() == 0
    merged = 0
    for k in range(6):
        source.put([(p := rng.randrange(3), f"k{rng.randrange(40)}", None if rng.random() < 0.3 else f"v{k}-{p}") for _ in range(60)])
        source.check(log.restored())
        source.check(sinks.replayed(spark, root))
        before = log.manifest()
        if log.compact(now_ms=1000 * k):
            merged += 1
            m = log.manifest()
            assert m.version == before.version + 1 and m.upto == source.batch - 1
            rows = spark.read.parquet(m.path)
            assert rows.count() == m.rows == rows.select("of", "key").distinct().count()
            assert not log._batches(m.upto) and not os.path.exists(f"{root}/outputs/batch={source.batch - 1}/out=changelog")
        source.check(log.restored())
        source.check(sinks.replayed(spark, root))
    assert 2 <= merged <= 6
    assert sinks.outputs(spark, root, "forward").count() == 6  # other outputs stay
    names = [n for n in os.listdir(f"{root}/compacted") if n.startswith("snapshot-")]
    assert len(names) <= 2
    boot = sinks.bootstrap(sinks.changelog(spark, root))
    assert boot.where("item_key is not null").count() == len(source.store)


def test_small_tails_wait_and_deletions_go_after_their_time(spark, tmp_path):
    source, log = Source(spark, str(tmp_path)), CompactedLog(spark, str(tmp_path), retention_ms=100)
    source.put([(0, f"k{i}", "v") for i in range(50)])
    assert log.compact(now_ms=0)
    source.put([(0, "k1", None), (0, "k2", "w")])
    assert not log.compact(now_ms=1) and log.manifest().version == 1  # 2 of 52
    assert log.compact(now_ms=10, force=True)
    deleted = lambda: {bytes(r.key): r.deleted_ms for r in spark.read.parquet(log.manifest().path).where("value is null").collect()}
    assert deleted() == {b"k1": 10}
    source.put([(0, "k3", None)])
    assert log.compact(now_ms=105, force=True) and deleted() == {b"k1": 10, b"k3": 105}
    source.put([(0, "k4", "w")])
    assert log.compact(now_ms=120, force=True) and deleted() == {b"k3": 105}
    source.check(log.restored())


def test_one_of_two_merges_at_a_time_commits(spark, tmp_path):
    source, log = Source(spark, str(tmp_path)), CompactedLog(spark, str(tmp_path))
    source.put([(0, "a", "1")])
    assert log.compact()
    with pytest.raises(Exception, match="exists"):
        log._commit(Manifest(1, 0, 1, "elsewhere"))
    assert log.manifest().path != "elsewhere"
    source.check(log.restored())


def test_a_stream_sees_an_update_of_the_table_between_two_batches(spark, tmp_path):
    source = Source(spark, f"{tmp_path}/table")
    source.put([(0, "a", "old"), (0, "b", "b")])
    table = GlobalTable(spark, source.root, f"{tmp_path}/global", lambda store: store.select(F.decode("key", "UTF-8").alias("k"), F.decode("value", "UTF-8").alias("v")))
    path, seen = f"{tmp_path}/in", []
    spark.createDataFrame([("a", 1), ("x", 2)], "k string, n int").coalesce(1).write.parquet(path)
    rows = spark.readStream.schema("k string, n int").parquet(path)
    run = table.follow(["k"], lambda df, batch: seen.append({(r.k, r.n, r.v) for r in df.collect()}))
    query = rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="100 milliseconds").start()
    try:
        query.processAllAvailable()
        source.put([(0, "a", "new"), (0, "b", None)])
        spark.createDataFrame([("a", 3), ("b", 4)], "k string, n int").coalesce(1).write.mode("append").parquet(path)
        query.processAllAvailable()
    finally:
        query.stop()
    assert [x for x in seen if x] == [{("a", 1, "old"), ("x", 2, None)}, {("a", 3, "new"), ("b", 4, None)}]
    for limit, how in ((0, "Sort"), (10**9, "Broadcast")):
        table.most_bytes = limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = table.joined(spark.createDataFrame([("a",)], "k string"), ["k"])._jdf.queryExecution().sparkPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert f"{how}MergeJoin" in plan or f"{how}HashJoin" in plan
