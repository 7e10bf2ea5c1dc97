"""Stateful handlers on a stream: keyed state, outputs to forward, change-log entries, timers."""

from __future__ import annotations

import json
from base64 import b64decode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.timers import NO_OFFSET, next_due
from ..sources.config import ExecutionState
from . import frames, held, ordered

#: Every output row: out tells forwarded records, change-log entries, dead letters, jobs and commits apart; a null value deletes; seq
#: counts a group's rows for good; home is the key of a group that is a key, and null where groups are partitions.
OUTPUT = "out string, topic string, partition int, offset bigint, key binary, value binary, record_type string, seq bigint, home binary, source string"
#: The topic of what comes back from jobs, and the headers that say which record they were of and what went wrong.
DONE, OF_TOPIC, OF_KEY, ERROR = "millrace.done", "millrace.topic", "millrace.key", "millrace.error"
#: Types of commit rows: a mark before which all is done, and one that a held record stops.
REACHED, HELD = "reached", "held"
STATE_KEY, STATE_VALUE = "key binary", "value binary, record_type string"
#: Groups where state is by key: keys are dealt to so many by a hash, for good.
SHARDS = 512
#: What names whose state it is: a partition's or a shard's own, that of records without a key, or, with the key behind it, that of a key.
WHOLE, NO_KEY, KEY = b"", b"\0", b"\1"
#: Columns of an initial state (sinks.bootstrap).
INITIAL = ["home", "partition", "item_key", "value", "record_type", "seq", "topic", "next_offset"]


def shard(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


class Record(NamedTuple):
    """A record as its handler gets it. What few handlers look at is told apart when it is asked for."""

    topic: str
    partition: int
    offset: int
    key: bytes | None
    value: bytes | None
    record_type: str
    rest: str

    @property
    def headers(self) -> list[dict[str, Any]]:
        found = json.loads(self.rest).get("headers") or []
        return [{"key": h.get("key"), "value": None if h.get("value") is None else b64decode(h["value"])} for h in found]

    @property
    def timestamp(self) -> datetime | None:
        micros = json.loads(self.rest).get("timestamp")
        return None if micros is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)

    @property
    def leader_epoch(self) -> int | None:
        return json.loads(self.rest).get("leader_epoch")


def as_records(rows: DataFrame, *more: Column) -> DataFrame:
    """Envelope rows with the columns of a Record."""
    rest = F.to_json(F.struct("leader_epoch", F.unix_micros("timestamp").alias("timestamp"), "headers"))
    return rows.select(*more, *Record._fields[:-1], rest.alias("rest"))


class Output(NamedTuple):
    """A row of OUTPUT."""

    out: str
    topic: str
    partition: int
    offset: int
    key: bytes | None
    value: bytes | None
    record_type: str
    seq: int
    home: bytes | None
    source: str


@dataclass
class Context:
    """What a handler gets with each record: the record, its partition's (or key's) store, and where its outputs go.

    In an interjection there is no record: input is None and the offset is -1.
    """

    partition: int
    input: Record | None
    _state: Any
    topic: str = ""
    seq: int = 0
    rows: list[Output] = field(default_factory=list)
    home: bytes | None = None
    #: Of a record that a job came back for: its own topic and offset.
    of: tuple[str, int] | None = None
    scheduled: str | None = None
    #: The group's ordered state and its queue, of a source that has them (EventSource.with_ordered_state).
    ordered: ordered.Sorted | None = None
    queue: ordered.Queue | None = None

    @property
    def offset(self) -> int:
        return NO_OFFSET if self.input is None else self.input.offset

    @property
    def source(self) -> str:
        """The topic of the record; empty in an interjection."""
        return self.of[0] if self.of else "" if self.input is None else self.input.topic

    @property
    def is_interjection(self) -> bool:
        return self.input is None

    def _out(self, out: str, topic: str, key: bytes, value: bytes | None, kind: str) -> None:
        self.rows.append(Output(out, topic, self.partition, self.offset, key, value or None, kind, self.seq, self.home, self.source))
        self.seq += 1

    def schedule(self, stage: str, key: bytes, value: bytes) -> ExecutionState:
        """Leave the record to a stage of work outside the store (EventSource.register_async): `return ctx.schedule(...)`. It is
        held until the stage's finalizer, or that of a later stage, is done with it. A record is in one stage at a time."""
        if self.input is None or self.scheduled is not None:
            raise RuntimeError("one stage for each record, and none for an interjection")
        self.scheduled = stage
        self._out("job", stage, key, value, "")
        return ExecutionState.INCOMPLETE

    def forward(self, topic: str, key: bytes, value: bytes, kind: str = "") -> None:
        self._out("forward", topic, key, value, kind)

    def record_change(self, key: bytes, value: bytes | None, kind: str = "") -> None:
        """An entry of the change log, in the record's own partition."""
        self._out("changelog", self.topic, key, value, kind)

    def get(self, key: bytes) -> bytes | None:
        found = self._state.getValue((key,)) if self._state.containsKey((key,)) else None
        return None if found is None else bytes(found[0])

    def put(self, key: bytes, value: bytes, kind: str = "") -> None:
        """Upsert, and tell the change log."""
        self._state.updateValue((key,), (value, kind))
        self.record_change(key, value, kind)

    def delete(self, key: bytes) -> bool:
        """Remove; only a key that is there leaves an entry."""
        if not self._state.containsKey((key,)):
            return False
        self._state.removeKey((key,))
        self.record_change(key, None)
        return True

    def keys(self) -> Iterator[bytes]:
        """Keys of the store, in order."""
        return iter(sorted(bytes(k[0]) for k in self._state.keys()))


Handler = Callable[[Context, Any], ExecutionState | None]
Interjection = Callable[[Context], None]
#: Gets the context, with the store, the job's key, its result and its error.
Finalizer = Callable[[Context, bytes, bytes | None, str | None], ExecutionState | None]


@dataclass
class HandlerTable:
    """Handlers by record type with their decoders; what a worker runs for each record."""

    chain: list[tuple[str, Callable[[bytes | None], Any], Handler]] = field(default_factory=list)
    default: Handler | None = None
    fail_on_decode: bool = False
    finalizers: dict[str, Finalizer] = field(default_factory=dict)

    def finalize(self, ctx: Context, stage: str, key: bytes, error: str | None) -> ExecutionState | None:
        """What a job that came back leads to. A stage without finalizer is done, whatever came of its work."""
        r, run = ctx.input, self.finalizers.get(stage)
        state = None if run is None else run(ctx, key, None if r.value is None else bytes(r.value), error)
        return self._checked(state, ctx)

    def _checked(self, state: ExecutionState | None, ctx: Context) -> ExecutionState | None:
        if state is ExecutionState.FATAL:
            raise RuntimeError(f"a handler of {ctx.input.record_type} failed at partition {ctx.partition}, offset {ctx.offset}")
        if (state is ExecutionState.INCOMPLETE) != (ctx.scheduled is not None):
            raise RuntimeError(f"{ctx.input.record_type}: a record is incomplete if, and only if, a stage has it")
        return state

    def handle(self, ctx: Context) -> ExecutionState | None:
        r = ctx.input
        raw = None if r.value is None else bytes(r.value)
        for kind, decode, handler in self.chain:
            if kind == r.record_type:
                try:
                    event = decode(raw)
                except Exception as e:
                    if self.fail_on_decode:
                        raise
                    ctx._out("dead_letter", ctx.topic, bytes(r.key or b""), str(e).encode(), r.record_type)
                    return None
                break
        else:
            handler, event = self.default, raw
            if handler is None:
                ctx._out("dead_letter", ctx.topic, bytes(r.key or b""), b"no handler", r.record_type)
                return None
        return self._checked(handler(ctx, event), ctx)


def _order(t: tuple) -> tuple:
    """What came back from jobs is first, then records by offset."""
    return t[0] != DONE, t[2], t[0], t[1]


class Call:
    """The state of a group while its rows are handled, and the outputs so far."""

    def __init__(self, states: PartitionProcessor):
        self._states = states
        self.items, self.due, self.at, self._saved = held.Held(states.items), held.Held(states.due, flat=True), held.Held(states.at, flat=True), held.Held(states.heads, flat=True)
        self.pending = held.Pending(states.pending)
        self._all = [self.items, self.due, self.at, self._saved, self.pending]
        if states.block is not None:
            self.maps = [(held.Held(blocks, sure=True), held.Held(index, flat=True)) for blocks, index in states.maps]
            self._all += [x for pair in self.maps for x in pair]
        self._heads: dict[bytes, Head] = {}
        self._ordered: dict[bytes, dict] = {}

    def head(self, home: bytes) -> Head:
        if home not in self._heads:
            found = self._saved.getValue((home,))
            self._heads[home] = Head() if found is None else Head(found[0], found[1], dict(zip(zip(found[2], found[3], strict=True), found[4], strict=True)), False)
        return self._heads[home]

    def store(self, home: bytes) -> held.Held | held.Part:
        return self.items if self._states.by == "partition" else held.Part(self.items, (home,), self._heads[home].new)

    def ordered(self, home: bytes) -> dict:
        """Ordered state and queue, for contexts: the index is read once."""
        if self._states.block is None:
            return {}
        if home not in self._ordered:
            first, new = () if self._states.by == "partition" else (home,), self._heads[home].new
            own, places = (ordered.Sorted(held.Part(blocks, first), held.Value(index, (home,), new), self._states.block) for blocks, index in self.maps)
            self._ordered[home] = {"ordered": own, "queue": ordered.Queue(own, ordered.Places(places))}
        return self._ordered[home]

    @property
    def size(self) -> int:
        return sum(x.size for x in self._all)

    def drop(self) -> None:
        """All that has changed goes to the state; nothing is held."""
        for home, h in self._heads.items():
            self._saved.updateValue((home,), (h.seq, h.last, [t for t, _ in h.marks], [p for _, p in h.marks], list(h.marks.values())))
        for x in self._all:
            x.drop()
        self._heads.clear()
        self._ordered.clear()


@dataclass
class Head:
    """How far a partition, or a key, is: the number of its next output, the partition of its last record, to which a timer's outputs go, and
    its next offset of each topic and partition, of which the records of a key may come from several."""

    seq: int = 0
    last: int | None = None
    marks: dict[tuple[str, int], int] = field(default_factory=dict)
    #: Nothing of it is in the state yet.
    new: bool = True


class PartitionProcessor(StatefulProcessor):
    """State of each group (a partition, or a shard of keys) as maps: from record key to value, in a shard from key and record key.

    Rows of a batch come in no order: jobs that came back are first, then records by offset; those below the next offset of their
    topic and partition are stale and dropped. Records that a stage has are pending; the commit rows of a batch say, for each topic
    and partition of the group, how far all is done: a pending record stops the mark. Timers are of processing time and set again when their interjection has
    run. Outputs leave as they are made, some thousand at a time. What handlers read and write is held while the rows of a batch go through, and written once.
    """

    def __init__(self, table: HandlerTable, topic: str, timers: list[tuple[int, int, Interjection]] | None = None, by: str = "partition", block: int | None = None):
        self.table, self.topic, self.timers, self.by, self.block = table, topic, timers or [], by, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        first = "" if self.by == "partition" else "home binary, "
        self.items = handle.getMapState("items", first + STATE_KEY, STATE_VALUE)
        self.heads = handle.getMapState("heads", "home binary", "seq bigint, last int, topics array<string>, partitions array<int>, offsets array<bigint>")
        self.pending = handle.getMapState("pending", *held.PENDING)
        self.due = handle.getMapState("due", "home binary, timer int", "at bigint")
        #: Whose timers are due at a time.
        self.at = handle.getMapState("at", "at bigint", "homes array<binary>, timers array<int>")
        if self.block is not None:
            # The map in order, and that from a queue's items to their places in it.
            self.maps = [(handle.getMapState(blocks, first + ordered.BLOCKS[0], ordered.BLOCKS[1]), handle.getMapState(index, "home binary", ordered.INDEX)) for blocks, index in (("blocks", "index"), ("places", "places_index"))]

    def handleInitialState(self, key, initialState, timerValues):
        """Entries of a bootstrap (sinks.bootstrap): items of the store, or, without a key, where a group goes on."""
        call = Call(self)
        for home, part, item, value, kind, seq, topic, offset in zip(*(initialState[c].tolist() for c in INITIAL), strict=True):
            name = self._name(home)
            head = call.head(name)
            if item is not None:
                call.store(name).updateValue((bytes(item),), (bytes(value), kind))
                continue
            if seq is not None:
                head.seq, head.last = int(seq), int(part)
            if offset is not None:
                head.marks[topic, int(part)] = int(offset)
        call.drop()

    def _name(self, key: bytes | None) -> bytes:
        return WHOLE if self.by == "partition" else NO_KEY if key is None else KEY + bytes(key)

    def handleInputRows(self, key, rows, timerValues):
        yield from frames.in_frames(self._handled(key, rows, timerValues), Output._fields)

    def _handled(self, key, rows, timerValues) -> Iterator[Output]:
        call, seen, some = Call(self), {}, False
        for n, t in enumerate(frames.in_order(rows, Record._fields, _order)):
            r = Record._make(t)
            heads = {h["key"]: h["value"] for h in r.headers} if r.topic == DONE else {}
            at = (bytes(heads[OF_TOPIC]).decode() if heads else r.topic, r.partition)
            home = None if self.by == "partition" or r.key is None else r.key
            name = self._name(home)
            head = call.head(name)
            mark = head.marks.setdefault(at, 0)
            seen[at] = max(seen.get(at, 0), mark)
            if not heads and r.offset < mark:
                continue
            # Once for each stage: what came back before, or is of another run of a batch, finds nothing pending.
            if heads and call.pending.get(at, r.offset) != r.record_type:
                continue
            ctx = Context(r.partition, r, call.store(name), self.topic, head.seq, home=home, of=(at[0], r.offset) if heads else None, **call.ordered(name))
            if heads:
                call.pending.remove(at, r.offset)
                error = heads.get(ERROR)
                self.table.finalize(ctx, r.record_type, bytes(heads[OF_KEY]), None if error is None else bytes(error).decode())
            else:
                self.table.handle(ctx)
                head.marks[at] = r.offset + 1
                seen[at] = max(seen[at], r.offset + 1)
            if ctx.scheduled is not None:
                call.pending.put(at, r.offset, ctx.scheduled)
                some = True
            yield from ctx.rows
            head.seq, head.last = ctx.seq, r.partition
            if self.timers:
                self._set(call, name, timerValues)
            if n % held.EVERY == 0 and call.size > held.MOST:
                call.drop()
        yield from self._commits(call, key, seen, call.pending.lows() if self.table.finalizers or some else {})
        call.drop()

    def _commits(self, call: Call, key: tuple, seen: dict[tuple[str, int], int], lows: dict[tuple[str, int], int]) -> Iterator[Output]:
        """How far the group is. The keys of a shard tell it together, under a name of their shard."""
        home = None if self.by == "partition" else f"shard {key[0]}".encode()
        head = call.head(WHOLE)
        for (topic, part), mark in sorted(seen.items()):
            mark = head.marks[topic, part] = max(mark, head.marks.get((topic, part), 0))
            stop = lows.get((topic, part))
            yield Output("commit", topic, part, mark if stop is None else stop, None, None, REACHED if stop is None else HELD, head.seq, home, topic)
            head.seq += 1

    def _set(self, call: Call, name: bytes, timerValues) -> None:
        for i in range(len(self.timers)):
            if not call.due.containsKey((name, i)):
                self._arm(call, name, i, timerValues.getCurrentProcessingTimeInMs())

    def _arm(self, call: Call, name: bytes, i: int, now: int) -> None:
        at = next_due(now, *self.timers[i][:2])
        call.due.updateValue((name, i), (at,))
        names, timers = call.at.getValue((at,)) or ([], [])
        if not names:
            self.handle.registerTimer(at)
        names.append(name)
        timers.append(i)
        call.at.updateValue((at,), (names, timers))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from frames.in_frames(self._expired(key, timerValues, expiredTimerInfo.getExpiryTimeInMs()), Output._fields)

    def _expired(self, key, timerValues, fired: int) -> Iterator[Output]:
        call = Call(self)
        names, timers = call.at.getValue((fired,)) or ([], [])
        call.at.removeKey((fired,))
        for name, i in zip([bytes(x) for x in names], timers, strict=True):
            if call.due.getValue((name, i)) is None or call.due.getValue((name, i))[0] != fired:
                continue
            head, home = call.head(name), name[1:] if name.startswith(KEY) else None
            ctx = Context(key[0] if head.last is None else head.last, None, call.store(name), self.topic, head.seq, home=home, **call.ordered(name))
            self.timers[i][2](ctx)
            yield from ctx.rows
            head.seq = ctx.seq
            self._arm(call, name, i, timerValues.getCurrentProcessingTimeInMs())
            if call.size > held.MOST:
                call.drop()
        call.drop()

    def close(self) -> None:
        pass
