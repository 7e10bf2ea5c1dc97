"""Batches in a stream: by size, by delay, in order, with errors and with events that have no items."""

import os
import time

import pytest

from millrace.operators import asynchronous
from millrace.streaming import batching
from millrace.streaming.event_source import ROCKSDB

ITEMS = "partition int, offset long, event long, item_ix int, n_items int, key binary, value binary"


def feed(spark, path, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(path)


def items(values, key=b"k", event=1, partition=0, offset=0):
    return [(partition, offset, event, k, len(values), key, str(v).encode()) for k, v in enumerate(values)] or [(partition, offset, event, None, 0, key, None)]


def settle(spark, tmp, execute, size, n, delay_ms=400, lanes=1, name="a", seconds=60):
    """All that is settled once there are n rows; batches as {(lane, batch): values in order}."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = batching.in_batches(spark.readStream.schema(ITEMS).parquet(f"{tmp}/in"), execute, size, delay_ms, lanes)
    query = rows.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/check").trigger(processingTime="100 milliseconds").start()
    end, got = time.time() + seconds, []
    while time.time() < end and len(got) < n and query.isActive:
        time.sleep(0.5)
        if os.path.isdir(f"{tmp}/out/_spark_metadata"):
            got = spark.read.schema(batching.DONE).parquet(f"{tmp}/out").orderBy("lane", "batch", "place").collect()
    query.stop()
    assert query.exception() is None
    out = {}
    for r in got:
        out.setdefault((r.lane, r.batch), []).append(r)
    return out


def negated(batch):
    return [b"%d" % -int(v) for _, v in batch]


def test_twenty_items_are_two_executions_in_order(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", items(range(20)))
    got = settle(spark, tmp_path, negated, 10, 20, delay_ms=60_000)
    assert {k: [int(bytes(r.value)) for r in v] for k, v in got.items()} == {(0, 0): list(range(10)), (0, 1): list(range(10, 20))}
    assert all(int(bytes(r.result)) == -int(bytes(r.value)) for v in got.values() for r in v)
    rows = spark.read.schema(batching.DONE).parquet(f"{tmp_path}/out")
    done = asynchronous.completed(rows, "event", rows.error.isNotNull()).first()
    assert (done["items"], done["failures"]) == (20, 0)


def test_no_items_no_execution(spark, tmp_path):
    def never(batch):
        raise AssertionError("executed")

    feed(spark, f"{tmp_path}/in", items([]))
    got = settle(spark, tmp_path, never, 10, 1)
    ((row,),) = got.values()
    assert row.event == 1 and row.item_ix is None and row.error is None


def test_what_is_open_goes_after_the_delay_and_over_a_restart(spark, tmp_path):
    def execute(batch):
        if any(v == b"13" for _, v in batch):
            raise ValueError("bad luck")
        return [ValueError("seven") if v == b"7" else v for _, v in batch]

    feed(spark, f"{tmp_path}/in", items([1, 2, 3], b"a", 1, 0, 0) + items([7, 8], b"b", 2, 1, 0))
    got = settle(spark, tmp_path, execute, 4, 4, delay_ms=60_000)  # one batch by size; one item stays open, in the state
    assert [bytes(r.value) for v in got.values() for r in v] == [b"1", b"2", b"3", b"7"]
    feed(spark, f"{tmp_path}/in", items([13], b"a", 3, 0, 1))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    got = settle(spark, tmp_path, execute, 2, 6, delay_ms=300)
    assert {(bytes(r.value), r.error) for v in got.values() for r in v} == {(b"1", None), (b"2", None), (b"3", None), (b"7", "seven"), (b"8", "bad luck"), (b"13", "bad luck")}
    rows = spark.read.schema(batching.DONE).parquet(f"{tmp_path}/out")
    assert {tuple(r) for r in asynchronous.completed(rows, "event", rows.error.isNotNull()).collect()} == {(1, 3, 0), (2, 2, 2), (3, 1, 1)}
    with pytest.raises(ValueError):
        batching.in_batches(rows, execute, 0)
