import json
import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.plans import catalog
from millrace.sources import envelope
from millrace.sources.config import ErrorResponse, ExecutionState, SourceConfig
from millrace.streaming import mocks, sinks
from millrace.streaming.event_source import EventSource, PartitionNotAssigned
from millrace.streaming.runtime import RunStatus


def write(spark, rows, path, k):
    """A file that the stream takes after the earlier ones."""
    rows = spark.createDataFrame([(r[0], r[1], r[2].encode(), None if r[3] is None else r[3].encode(), r[4]) for r in rows], "partition int, offset long, key binary, value binary, record_type string")
    full = rows.selectExpr("'t' topic", "partition", "offset", "0 leader_epoch", "timestamp'2024-01-01' timestamp", "key", "value", f"cast(array() as {envelope.HEADERS}) headers", "record_type")
    full.coalesce(1).write.mode("append").parquet(path)
    for f in os.listdir(path):
        if f.endswith(".parquet") and not hasattr(write, f"seen_{path}_{f}"):
            setattr(write, f"seen_{path}_{f}", 1)
            os.utime(f"{path}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))


def create(ctx, event):
    ctx.put(bytes(ctx.input.key), json.dumps(event).encode(), "contact")
    return ExecutionState.COMPLETE


def notify(ctx, event):
    found = ctx.get(bytes(ctx.input.key))
    ctx.forward("mail", bytes(ctx.input.key), b"sent" if found else b"unknown")


def source(spark, tmp_path, name="g", **options):
    rows = envelope.from_files(spark, f"{tmp_path}/in", 1)
    es = EventSource(spark, SourceConfig(name, "t", num_partitions=2, **options), rows, f"{tmp_path}/out")
    es.register("create", json.loads, create).register("notify", lambda b: b, notify)
    return es.register("delete", lambda b: b, lambda ctx, _: ctx.delete(bytes(ctx.input.key)) and None)


def test_contacts_over_restarts(spark, tmp_path):
    """Create, notify, delete, notify; a restart in between; stale and malformed records; store, change log and state agree."""
    path = f"{tmp_path}/in"
    write(spark, [(0, 1, "a", None, "notify"), (0, 0, "a", '{"n":1}', "create"), (1, 0, "b", '{"n":2}', "create")], path, 1)
    es = source(spark, tmp_path).start(available_now=True)
    assert es.wait() and es.error is None
    write(spark, [(0, 1, "a", None, "notify"), (0, 2, "a", None, "delete"), (0, 3, "a", None, "notify"), (0, 4, "c", "{", "create"), (1, 1, "d", "x", "odd"), (1, 2, "zz", None, "delete")], path, 2)
    es = source(spark, tmp_path).start(available_now=True)
    assert es.wait() and es.error is None
    root = f"{tmp_path}/out"
    mail = [(bytes(r.key), bytes(r.value)) for r in sinks.outputs(spark, root, "forward").orderBy("batch", "offset").collect()]
    assert mail == [(b"a", b"sent"), (b"a", b"unknown")]
    assert {r.record_type for r in sinks.outputs(spark, root, "dead_letter").collect()} == {"create", "odd"}
    log = sinks.outputs(spark, root, "changelog")
    assert log.count() == 3 and log.where("value is null").count() == 1
    assert [(r.partition, bytes(r.key), bytes(r.value)) for r in sinks.replayed(spark, root).collect()] == [(1, b"b", b'{"n": 2}')]
    assert [(r.partition, bytes(r.item_key)) for r in es.store().collect()] == [(1, b"b")]
    assert es.interject(1, lambda s: s.select(F.count("*"))).first()[0] == 1
    assert es.interject_all(lambda s: s.groupBy("partition").count()).count() == 1
    for p in (0, 9):
        with pytest.raises(PartitionNotAssigned):
            es.interject(p, lambda s: s)
    deadline = time.time() + 10
    while not es.metrics.rows and time.time() < deadline:
        time.sleep(0.1)
    assert es.metrics.rows[0].operation == "TxnCommit"


def test_decode_policy_fails_at_once(spark, tmp_path):
    write(spark, [(0, 0, "a", "{", "create")], f"{tmp_path}/in", 1)
    seen = []
    es = source(spark, tmp_path, "strict", on_decode_error=lambda e: ErrorResponse.FAIL_CONSUMER, on_txn_error=lambda e: seen.append(e) or ErrorResponse.FAIL_CONSUMER)
    es.start(available_now=True).wait()
    assert es.error is not None and seen and es.state == "unhealthy"


def test_timer_repeats(spark, tmp_path):
    write(spark, [(0, 0, "a", '{"n":1}', "create")], f"{tmp_path}/in", 1)
    es = source(spark, tmp_path, "timed").schedule_interjection(lambda ctx: ctx.forward("tick", b"t", str((ctx.offset, len(list(ctx.keys())))).encode()), 300, 50)
    es.start()
    deadline = time.time() + 60
    while time.time() < deadline:
        time.sleep(1)
        if sinks.outputs(spark, f"{tmp_path}/out", "forward").count() >= 2:
            break
    assert es.state == "healthy"
    es.stop_now()
    ticks = [bytes(r.value) for r in sinks.outputs(spark, f"{tmp_path}/out", "forward").collect()]
    assert len(ticks) >= 2 and set(ticks) == {b"(-1, 1)"}


def test_batch_that_runs_again_counts_once(spark, tmp_path):
    df = spark.sql("SELECT 'forward' out, 't' topic, 0 partition, 1L offset, CAST('k' AS BINARY) key, CAST('v' AS BINARY) value, '' record_type, 0L seq, CAST(NULL AS BINARY) home, 't' source")
    sink = sinks.once(str(tmp_path))
    for _ in range(2):
        sink(df, 0)
    assert sinks.outputs(spark, str(tmp_path), "forward").count() == 1


def test_stream_ends_where_the_batch_query_does(spark, data, tmp_path):
    rows = envelope.from_events(spark, data)
    value = F.when(F.col("event_type") != "error", F.to_json(F.struct("event_id", "value")))
    env = envelope.as_envelope(rows, "events", F.encode(F.col("user_id").cast("string"), "UTF-8"), F.encode(value, "UTF-8"), F.col("event_type"))
    env.coalesce(1).write.parquet(f"{tmp_path}/in")
    es = EventSource(spark, SourceConfig("all", "events", num_partitions=10), envelope.from_files(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    for kind in ("signup", "view", "click", "purchase"):
        es.register(kind, lambda b: b, lambda ctx, raw: ctx.put(bytes(ctx.input.key), raw))
    es.register("error", lambda b: b, lambda ctx, raw: ctx.delete(bytes(ctx.input.key)) and None)
    es.start(available_now=True).wait()
    assert es.error is None
    got = {(r.partition, int(bytes(r.key)), json.loads(bytes(r.value))["event_id"]) for r in sinks.replayed(spark, f"{tmp_path}/out").collect()}
    assert got == {(r.part, r.user_id, r.event_id) for r in catalog.QUERIES["store_final"](spark, data).collect()}


def test_change_log_keeps_the_order_of_changes(spark, tmp_path):
    """Several changes of a key by one record, put then delete, and a timer that writes after the records of its batch."""
    path, root = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, [(0, 0, "a", "x", "twice"), (0, 1, "b", "x", "gone"), (0, 2, "c", "x", "back"), (0, 3, "t", "x", "put")], path, 1)
    rows = envelope.from_files(spark, path, 1)
    es = EventSource(spark, SourceConfig("ordered", "t", num_partitions=1), rows, root)

    def twice(ctx, _):
        ctx.put(b"a", b"1")
        ctx.put(b"a", b"2")

    def gone(ctx, _):
        ctx.put(b"b", b"1")
        ctx.delete(b"b")

    def back(ctx, _):
        ctx.put(b"c", b"1")
        ctx.delete(b"c")
        ctx.put(b"c", b"3")

    for kind, run in (("twice", twice), ("gone", gone), ("back", back), ("put", lambda ctx, raw: ctx.put(b"t", raw))):
        es.register(kind, lambda b: b, run)
    es.schedule_interjection(lambda ctx: ctx.put(b"t", b"timer"), 300)
    es.start()
    deadline = time.time() + 60
    while time.time() < deadline:
        time.sleep(1)
        if sinks.outputs(spark, root, "changelog").where("offset = -1").count() >= 2:
            break
    es.stop_now()
    live = {bytes(r.item_key): bytes(r.value) for r in es.store().collect()}
    got = {bytes(r.key): bytes(r.value) for r in sinks.replayed(spark, root).collect()}
    assert got == live == {b"a": b"2", b"c": b"3", b"t": b"timer"}
    log = sinks.outputs(spark, root, "changelog")
    assert log.count() == log.select("seq").distinct().count()


def test_files_in_the_order_of_offsets(spark, data, tmp_path):
    """Many small slices, one file at a time: the stream drops nothing as stale."""
    rows = envelope.from_events(spark, data)
    env = envelope.as_envelope(rows, "events", F.encode(F.col("user_id").cast("string"), "UTF-8"), F.encode("props", "UTF-8"), F.col("event_type"))
    envelope.write_in_order(env, f"{tmp_path}/in", 40)
    es = EventSource(spark, SourceConfig("slices", "events", num_partitions=10), envelope.from_files(spark, f"{tmp_path}/in", 15), f"{tmp_path}/out")
    es.register_default(lambda ctx, raw: ctx.forward("out", bytes(ctx.input.key), raw)).start(available_now=True).wait()
    assert es.error is None and sinks.outputs(spark, f"{tmp_path}/out", "forward").count() == rows.count()


def test_new_group_from_a_change_log(spark, tmp_path):
    """A second group takes over the store of the first: items, deletions, offsets; both logs together restore its store."""
    path, first, second = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/second"
    write(spark, [(0, 0, "a", '{"n":1}', "create"), (0, 1, "b", '{"n":2}', "create"), (0, 2, "a", None, "delete"), (1, 0, "c", '{"n":3}', "create")], path, 1)
    es = source(spark, tmp_path).start(available_now=True)
    assert es.wait() and es.error is None
    marks = spark.createDataFrame([(0, 3), (1, 1)], "partition int, next_offset long")
    write(spark, [(0, 3, "b", None, "notify"), (0, 4, "a", None, "notify"), (0, 5, "b", None, "delete"), (1, 1, "c", '{"n":4}', "create"), (1, 2, "d", '{"n":5}', "create")], path, 2)

    def taken_over():
        new = EventSource(spark, SourceConfig("g2", "t", num_partitions=2), envelope.from_files(spark, path, 1), second)
        new.register("create", json.loads, create).register("notify", lambda b: b, notify)
        new.register("delete", lambda b: b, lambda ctx, _: ctx.delete(bytes(ctx.input.key)) and None)
        return new.bootstrap(sinks.outputs(spark, first, "changelog"), marks)

    new = taken_over().start(available_now=True)
    assert new.wait() and new.error is None
    mail = [(bytes(r.key), bytes(r.value)) for r in sinks.outputs(spark, second, "forward").orderBy("seq").collect()]
    assert mail == [(b"b", b"sent"), (b"a", b"unknown")]  # rows before the marks are not handled again
    want = {(1, b"c", b'{"n": 4}'), (1, b"d", b'{"n": 5}')}
    assert {(r.partition, bytes(r.item_key), bytes(r.value)) for r in new.store().collect()} == want
    assert {(r.partition, bytes(r.key), bytes(r.value)) for r in sinks.replayed(spark, second, first).collect()} == want
    write(spark, [(1, 3, "c", None, "delete")], path, 3)
    again = taken_over().start(available_now=True)  # the second run has state of its own
    assert again.wait() and again.error is None
    assert [bytes(r.item_key) for r in again.store().collect()] == [b"d"]


def put(ctx, raw):
    ctx.put(bytes(ctx.input.key), raw)


def by_key(spark, path, root, name="k", kinds=("put",)):
    es = EventSource(spark, SourceConfig(name, "t", num_partitions=2), envelope.from_files(spark, path, 1), root, by="key")
    for kind in kinds:
        es.register(kind, bytes, put)
    return es.register("delete", lambda b: b, lambda ctx, _: ctx.delete(bytes(ctx.input.key)) and None)


def test_a_key_in_two_partitions_loses_nothing(spark, tmp_path):
    """Offsets belong to partitions: offset 0 of one is not stale for what a key has seen of another."""
    path, root = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, [(0, 5, "a", "first", "put"), (0, 6, "b", "x", "put")], path, 1)
    write(spark, [(1, 0, "a", "second", "put"), (0, 5, "a", "stale", "put")], path, 2)
    es = by_key(spark, path, root).start(available_now=True)
    assert es.wait() and es.error is None
    log = sinks.outputs(spark, root, "changelog").orderBy("seq")
    assert [bytes(r.value) for r in log.collect() if bytes(r.key) == b"a"] == [b"first", b"second"]
    assert {(r.partition, bytes(r.key), bytes(r.value)) for r in sinks.replayed(spark, root).collect()} == {(1, b"a", b"second"), (0, b"b", b"x")}
    assert {(r.topic, r.partition, r.next_offset) for r in sinks.commits(spark, root).collect()} == {("t", 0, 7), ("t", 1, 1)}


def test_new_group_by_key_from_both_logs(spark, tmp_path):
    """A new group of keys takes over items and marks from what the first left; no marks by hand."""
    path, first, second = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/second"
    write(spark, [(0, 0, "a", "1", "put"), (0, 1, "b", "2", "put"), (1, 0, "a", "3", "put"), (1, 1, "c", "4", "put"), (1, 2, "c", None, "delete")], path, 1)
    es = by_key(spark, path, first).start(available_now=True)
    assert es.wait() and es.error is None
    write(spark, [(0, 2, "b", None, "delete"), (1, 3, "d", "5", "put"), (0, 3, "a", "6", "put")], path, 2)
    new = by_key(spark, path, second, "k2").bootstrap_from(first).start(available_now=True)
    assert new.wait() and new.error is None
    want = {(0, b"a", b"6"), (1, b"d", b"5")}
    assert sinks.outputs(spark, second, "changelog").count() == 3  # nothing from before the marks is done again
    assert {(r.partition, bytes(r.key), bytes(r.value)) for r in sinks.replayed(spark, second, first).collect()} == want
    assert {(bytes(r.item_key), bytes(r.value)) for r in new.store().collect()} == {x[1:] for x in want}


def test_timers_of_keys_write_where_their_records_do(spark, tmp_path):
    path, root = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, [(1, 0, "a", "x", "put")], path, 1)
    es = by_key(spark, path, root).schedule_interjection(lambda ctx: ctx.put(b"a", b"timer"), 300)
    es.start()
    deadline = time.time() + 60
    while time.time() < deadline and not sinks.outputs(spark, root, "changelog").where("offset = -1").take(1):
        time.sleep(1)
    es.stop_now()
    assert [(r.partition, bytes(r.key), bytes(r.value)) for r in sinks.replayed(spark, root).collect()] == [(1, b"a", b"timer")]


def test_handlers_run_once_and_then_sees_what_was_written(spark, tmp_path):
    path, root, seen = f"{tmp_path}/in", f"{tmp_path}/out", []
    write(spark, [(0, 0, "a", "1", "count"), (0, 1, "b", "2", "count")], path, 1)
    ran = spark.sparkContext.accumulator(0)
    es = EventSource(spark, SourceConfig("once", "t", num_partitions=2), envelope.from_files(spark, path, 1), root)

    def count(ctx, raw):
        ran.add(1)
        ctx.forward("f", bytes(ctx.input.key), raw)

    es.register("count", bytes, count)
    es.start(available_now=True, then=lambda df, batch: seen.append((batch, sorted(bytes(r.key) for r in df.where("out = 'forward'").collect())))).wait()
    assert es.error is None and seen == [(0, [b"a", b"b"])] and ran.value == 2


def test_a_batch_without_a_commit_is_not_read(spark, tmp_path):
    """The sink fails after it has written; the batch runs again later. An empty batch leaves no folder."""
    path, root = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, [(0, 0, "a", '{"n":1}', "create")], path, 1)

    def stop(df, batch):
        raise RuntimeError("between sink and checkpoint")

    es = source(spark, tmp_path, "halved", on_txn_error=lambda e: ErrorResponse.FAIL_CONSUMER).start(available_now=True, then=stop)
    es.wait()
    assert es.error is not None and os.path.isdir(f"{root}/outputs/batch=0")
    assert sinks.outputs(spark, root, "changelog").count() == 0 and sinks.replayed(spark, root).count() == 0
    es = source(spark, tmp_path, "halved").start(available_now=True)
    assert es.wait() and es.error is None
    assert sinks.outputs(spark, root, "changelog").count() == 1
    sinks.once(f"{tmp_path}/none")(spark.createDataFrame([], sinks.OUTPUT), 7)
    assert not os.path.exists(f"{tmp_path}/none/outputs/batch=7") and sinks.outputs(spark, f"{tmp_path}/none", "forward").count() == 0


def test_work_outside_the_store_and_its_finalizers(spark, tmp_path):
    """Two stages: what a handler holds back is finalized with the store, in order for each key; errors reach the finalizer; a restart in
    between loses nothing; the commit log does not pass what is held."""
    path, root = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, [(0, k, "ab"[k % 2], str(k), "job") for k in range(20)] + [(1, 0, "c", "bad", "job"), (1, 1, "c", "1", "put")], path, 1)
    fail = {"on": True}

    def finalize_first(ctx, key, result, error):
        if error is not None:
            ctx.put(key, f"error {error}".encode())
            return ExecutionState.COMPLETE
        ctx.put(key, (ctx.get(key) or b"") + b" " + result)
        return ctx.schedule("second", key, result)

    def finalize_second(ctx, key, result, error):
        ctx.forward("done", key, result)

    def work(key, value):
        return str(2 * int(value)).encode()

    def start(then=None):
        es = EventSource(spark, SourceConfig("staged", "t", num_partitions=2, on_txn_error=lambda e: ErrorResponse.FAIL_CONSUMER), envelope.from_files(spark, path, 1), root)
        es.register("job", bytes, lambda ctx, raw: ctx.schedule("first", bytes(ctx.input.key), raw)).register("put", bytes, put)
        es.register_async("first", work, finalize_first).register_async("second", lambda k, v: b"<" + v + b">", finalize_second)
        es.start(available_now=True, then=then).wait()
        return es

    def stop(df, batch):
        if batch == 1 and fail["on"]:
            raise RuntimeError("lost")

    es = start(stop)  # the first stage has come back, and its finalizers' batch is lost
    assert es.error is not None and sinks.outputs(spark, root, "forward").count() == 0
    assert {(r.partition, r.next_offset) for r in sinks.commits(spark, root).collect()} == {(0, 0), (1, 0)}
    fail["on"] = False
    es = start()
    assert es.error is None
    done = sinks.outputs(spark, root, "forward").orderBy("batch", "seq").collect()
    for key in (b"a", b"b"):
        assert [bytes(r.value) for r in done if bytes(r.key) == key] == [f"<{2 * k}>".encode() for k in range(20) if "ab"[k % 2].encode() == key]
    store = {bytes(r.item_key): bytes(r.value) for r in es.store().collect()}
    assert store[b"a"] == b"".join(f" {2 * k}".encode() for k in range(0, 20, 2)) and store[b"c"].startswith(b"error invalid literal")
    assert {(r.partition, r.next_offset) for r in sinks.commits(spark, root).collect()} == {(0, 20), (1, 2)}
    assert {bytes(r.key): bytes(r.value) for r in sinks.replayed(spark, root).collect()} == store
    with pytest.raises(RuntimeError):
        mocks.interjection().schedule("first", b"k", b"v")


def test_pause_and_resume(spark, tmp_path):
    seen = []
    write(spark, [(0, 0, "a", '{"n":1}', "create")], f"{tmp_path}/in", 1)
    es = source(spark, tmp_path, "paused", on_assigned=lambda s: seen.append("assigned")).start()
    es.query.processAllAvailable()
    assert es.pause().state == "unhealthy"
    write(spark, [(0, 1, "a", None, "notify")], f"{tmp_path}/in", 2)
    es.resume().query.processAllAvailable()
    assert es.state == "healthy" and seen == ["assigned"]
    es.stop()
    assert [bytes(r.value) for r in sinks.outputs(spark, f"{tmp_path}/out", "forward").collect()] == [b"sent"]


def test_handlers_over_mocks():
    ctx = mocks.context(b"a", kind="create")
    create(ctx, {"n": 1})
    assert mocks.changes(ctx) == [(b"a", b'{"n": 1}')] and ctx.get(b"a") == b'{"n": 1}'
    later = mocks.context(b"a", offset=1, state=ctx._state)
    notify(later, None)
    assert later.delete(b"a") and not later.delete(b"a")
    assert mocks.forwarded(later) == [("mail", b"a", b"sent")] and mocks.changes(later) == [(b"a", None)]
    timer = mocks.interjection({b"z": b"1", b"b": b"2"})
    assert timer.is_interjection and timer.offset == -1 and list(timer.keys()) == [b"b", b"z"]


def test_run_status():
    top = RunStatus()
    a, b = top.fork(), top.fork().with_value("k", 1)
    c = b.fork()
    b.halt(ValueError("x"))
    assert not c.running and isinstance(c.error, ValueError) and top.running and a.running and c.value("k") == 1 and a.value("k") is None
    top.halt()
    assert not a.fork().running
