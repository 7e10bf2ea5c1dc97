"""What is held of a group's state while its rows go through: few calls to the state, bounded memory, the same results."""

import base64
import heapq
import random

import pandas as pd
import pytest

from millrace.operators import asynchronous
from millrace.streaming import batching, frames, held, mocks, processor
from millrace.streaming.ordered import sortable, unsorted


class State(mocks.MemoryState):
    """Counts calls, as each is a message to another process."""

    calls = 0


def counted(name):
    def call(self, *args):
        State.calls += 1
        return getattr(mocks.MemoryState, name)(self, *args)

    return call


for name in ("containsKey", "getValue", "updateValue", "removeKey", "keys"):
    setattr(State, name, counted(name))


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, State())

    def registerTimer(self, at):
        self.timers.add(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


class Source:
    """A processor over states in memory, batch after batch."""

    def __init__(self, table, by="partition", block=None, timers=()):
        self.handle, self.processor = Handle(), processor.PartitionProcessor(table, "log", list(timers), by, block)
        self.processor.init(self.handle)

    def run(self, rows, group=0, now=0):
        """rows: (topic, partition, offset, key, value, record_type, rest); the outputs."""
        State.calls = 0
        parts = [frames.frame(rows[k : k + 500], processor.Record._fields) for k in range(0, len(rows), 500)]
        return [processor.Output(*r) for f in self.processor.handleInputRows((group,), iter(parts), Now(now)) for r in f.itertuples(index=False)]


def record(offset, key, value, kind="x", topic="t", partition=0, rest="{}"):
    return topic, partition, offset, key, value, kind, rest


def events(n, users, seed=1):
    rng = random.Random(seed)
    return [record(k, b"%d" % rng.randrange(users), b"%d" % k) for k in range(n)]


def next_above(ctx, raw):
    own = sortable(int(ctx.input.key))
    found = ctx.ordered.next(own)
    ctx.forward("next", ctx.input.key, b"" if found is None else b"%d" % unsorted(found[0]))
    ctx.ordered.put(own, raw)


def test_ordered_state_is_read_and_written_once_a_batch():
    rows, seen, want = events(4000, 300), [], []
    for r in rows:
        user = int(r[3])
        want.append(min((u for u in seen if u > user), default=None))
        seen.append(user)
    source = Source(processor.HandlerTable(default=next_above), block=16)
    got, calls = [], 0
    for a in (0, 2000):
        part = rows[a : a + 2000]
        random.Random(3).shuffle(part)
        got += source.run(part)
        calls += State.calls
    said = [r.value for r in got if r.out == "forward"]
    assert [None if not v else int(v) for v in said] == want
    assert calls < 400  # there are some 40 blocks; each record's own calls were 4000 and more


def push(ctx, raw):
    ctx.queue.push(raw, int(ctx.input.key))
    if len(ctx.queue) > 20:
        ctx.queue.pop_least()


def test_a_queue_asks_nothing_for_items_that_come_and_go():
    rows = events(4000, 1000)
    source, calls = Source(processor.HandlerTable(default=push), block=8), 0
    for a in (0, 2000):
        source.run(rows[a : a + 2000])
        calls += State.calls
    left = [k for v in source.handle.maps["blocks"].items.values() for k in v[0]]
    assert sorted((unsorted(k), k[9:]) for k in left) == sorted(heapq.nlargest(20, [(int(r[3]), r[4]) for r in rows]))
    assert sum(len(v[0]) for v in source.handle.maps["places"].items.values()) == 20 and calls < 200


def staged():
    """Two stages, whose results this test gives back itself."""

    def second(ctx, key, result, error):
        ctx.put(key, (ctx.get(key) or b"") + result)

    table = processor.HandlerTable(default=lambda ctx, raw: ctx.schedule("a", ctx.input.key, raw))
    table.finalizers.update(a=lambda ctx, key, result, error: ctx.schedule("b", key, result), b=second)
    return table


@pytest.mark.parametrize("by", ["partition", "key"])
def test_held_records_are_in_blocks(by):
    def back(offset, key, stage):
        rest = '{"headers":[{"key":"millrace.topic","value":"dA=="},{"key":"millrace.key","value":"%s"}]}' % base64.b64encode(key).decode()
        return record(offset, key, b".", stage, processor.DONE, rest=rest)

    rows, source = events(3000, 50), Source(staged(), by)
    out = source.run(rows)
    assert sum(r.out == "job" for r in out) == 3000 and [(r.offset, r.record_type) for r in out if r.out == "commit"] == [(0, processor.HELD)]
    assert len(source.handle.maps["pending"].items) == 3 and State.calls < 500
    out = source.run([back(k, r[3], "a") for k, r in enumerate(rows) if k != 7])
    assert sum(r.out == "job" for r in out) == 2999 and [(r.offset, r.record_type) for r in out if r.out == "commit"] == [(0, processor.HELD)]
    done = [back(k, r[3], "b") for k, r in enumerate(rows)]
    out = source.run(done + done)  # what comes twice counts once; 7 is still in the first stage
    assert [(r.offset, r.record_type) for r in out if r.out == "commit"] == [(7, processor.HELD)] and State.calls < 500
    source.run([back(7, rows[7][3], "a")])
    out = source.run([back(7, rows[7][3], "b")])
    assert [(r.offset, r.record_type) for r in out if r.out == "commit"] == [(3000, processor.REACHED)] and not source.handle.maps["pending"].items
    assert sum(len(v[0]) for v in source.handle.maps["items"].items.values()) == 3000


@pytest.mark.parametrize("most", [held.MOST, 3_000])
def test_keys_of_a_shard_are_apart(monkeypatch, most):
    """Each key has its own store, numbers and marks; with little memory all is written and read again in between."""
    monkeypatch.setattr(held, "MOST", most)

    def add(ctx, raw):
        ctx.put(b"n", b"%d" % (int(ctx.get(b"n") or 0) + 1))
        assert list(ctx.keys()) == [b"n"]

    rows = [record(k, None if k % 41 == 0 else b"k%d" % (k % 40), b"x", partition=k % 3) for k in range(1200)]
    want = {}
    for r in rows:
        want[r[3]] = want.get(r[3], 0) + 1
    source = Source(processor.HandlerTable(default=add), "key")
    out = source.run(rows[:600], 5) + source.run(rows[500:], 5)  # some come again, and are stale
    last = {r.home: int(r.value) for r in sorted(out, key=lambda r: r.seq) if r.out == "changelog"}
    assert last == want and len({(r.home, r.seq) for r in out}) == len(out)
    ends = {}
    for r in out:
        if r.out == "commit":
            assert r.home == b"shard 5"
            ends[r.partition] = r.offset
    assert ends == {p: max(k for k in range(1200) if k % 3 == p) + 1 for p in range(3)}


def test_timers_of_keys_in_a_shard():
    source = Source(processor.HandlerTable(default=lambda ctx, raw: ctx.put(b"n", raw)), "key", timers=[(100, 0, lambda ctx: ctx.put(b"t", ctx.get(b"n")))])
    source.run([record(0, b"a", b"1"), record(1, b"b", b"2", partition=1)], now=50)
    source.run([record(2, b"a", b"3")], now=60)
    assert source.handle.timers == {150}
    for fired, due in ((150, 260), (260, 360)):
        out = [processor.Output(*r) for f in source.processor.handleExpiredTimer((5,), Now(due - 100), Now(fired)) for r in f.itertuples(index=False)]
        assert sorted((r.home, r.partition, r.offset, r.key, r.value) for r in out) == [(b"a", 0, -1, b"t", b"3"), (b"b", 1, -1, b"t", b"2")]
        assert due in source.handle.timers


def test_order_on_disk():
    rng = random.Random(4)
    rows = [(rng.randrange(50), b"%d" % k, None if k % 3 else "s") for k in range(5000)]
    parts = [frames.frame(rows[k : k + 300], ["a", "b", "c"]) for k in range(0, 5000, 300)]
    for most in (700, 10**6):
        assert list(frames.in_order(iter(parts), ["a", "b", "c"], lambda t: (t[0], t[1]), most)) == sorted(rows, key=lambda t: (t[0], t[1]))


def test_batches_leave_as_they_are_filled(monkeypatch):
    """A lane's rows of one batch of the stream are never all in memory: neither those that come, nor results, nor a call for each batch."""
    monkeypatch.setattr(frames, "RUN", 1_000)
    monkeypatch.setattr(frames, "RETURNED", 100)
    calls = []

    class Once(mocks.MemoryValue):
        def update(self, value):
            calls.append(value)
            super().update(value)

    class Open(Once):
        put, clear = mocks.MemoryValue.update, lambda self: setattr(self, "value", None)

    class States(Handle):
        getListState, getValueState = (lambda self, *a: Open()), lambda self, *a: Once()

    executed = []
    lane = batching.Batcher(lambda items: executed.append(len(items)) or [v for _, v in items], 10, 5)
    lane.init(States())
    rows = [(p, k, str(2**60 + k), str(0), str(1), b"k", b"%d" % k) for p in (1, 0) for k in range(2504)]
    parts = (pd.DataFrame(rows[k : k + 400], columns=["partition", "offset", *batching._FIELDS]) for k in range(0, len(rows), 400))
    out = lane.handleInputRows((3,), parts, Now(0))
    first = next(out)
    assert len(first) == 100 and len(executed) <= 11
    got = [tuple(r) for f in (first, *out) for r in f[["event", "item_ix", "value", "result", "lane", "batch", "place"]].itertuples(index=False)]
    assert got == [(2**60 + k % 2504, 0, b"%d" % (k % 2504), b"%d" % (k % 2504), 3, k // 10, k % 10) for k in range(5000)]
    assert calls == [(500,), (5,)] and len(lane.open.get()) == 8


def test_records_tell_what_few_look_at():
    r = processor.Record("t", 0, 1, None, None, "x", '{"leader_epoch":3,"timestamp":1700000000123456,"headers":[{"key":"h","value":"AAE="},{"key":"n"}]}')
    assert r.headers == [{"key": "h", "value": b"\0\1"}, {"key": "n", "value": None}] and r.leader_epoch == 3 and r.timestamp.isoformat() == "2023-11-14T22:13:20.123456+00:00"
    assert processor.Record("t", 0, 1, None, None, "x", "{}").headers == []


def test_work_in_turn_takes_frames_of_several_keys(spark):
    """Each key's rows are in order; there is no frame for each key."""
    rows = spark.range(6000).selectExpr("id % 1000 AS key", "-id AS at")

    def work(p):
        return pd.DataFrame({"key": p["key"], "at": p["at"], "place": range(len(p)), "keys": p["key"].nunique(), "rows": len(p)})

    done = asynchronous.in_turn(rows.repartition(3), "key", "at", work, "key long, at long, place long, keys long, rows long").toPandas()
    assert len(done) == 6000 and done["keys"].min() > 100
    for _, own in done.sort_values(["key", "at"]).groupby("key"):
        assert list(own["at"]) == sorted(own["at"]) and list(own["place"]) == sorted(own["place"])
