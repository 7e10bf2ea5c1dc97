"""Items of many events executed together, in a stream: batches of a size, or of what there is after a delay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import frames

#: From the (key, value) of a batch's items, in order, to their results; an exception in place of a result is that item's error, one that
#: is raised is the error of all.
Execute = Callable[[list[tuple[bytes, bytes]]], list]

_ITEM = "event bigint, item_ix int, n_items int, key binary, value binary"
DONE = f"{_ITEM}, result binary, error string, lane int, batch bigint, place int"
_FIELDS, _DONE = ([c.split()[0] for c in schema.split(", ")] for schema in (_ITEM, DONE))
#: Milliseconds that a batch waits, unless told otherwise.
DELAY_MS = 5


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)


def _order(t: tuple) -> tuple:
    return t[0], t[1], -1 if t[3] is None else int(t[3])


class Batcher(StatefulProcessor):
    """One lane: an open batch, which is executed when it has `size` items, or by a timer that its first item sets.

    All items of a key are in one lane, and a lane runs one batch at a time, so that no two running batches hold a key. Rows of a lane are put in order
    on disk where they are many (frames.in_order), and results leave as they are made: memory is bounded, whatever a batch of the stream has. An open
    batch has fewer than `size` items, and lives in the state, over restarts too. An event without items has a place in the order, and is done with its batch, which
    is not executed for it. A batch that runs again after a failure is executed again; its results are written once.
    """

    def __init__(self, execute: Execute, size: int, delay_ms: int):
        self.execute, self.size, self.delay_ms = execute, size, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _ITEM)
        self.count = handle.getValueState("count", "batch bigint")
        self.due = handle.getValueState("due", "at bigint")

    def _batch(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def _done(self, lane: int, batch: int, held: list[tuple]) -> Iterator[tuple]:
        items = [x for x in held if x[1] is not None]
        results: list = []
        if items:
            try:
                results = list(self.execute([(x[3], x[4] or b"") for x in items]))
                if len(results) != len(items):
                    raise RuntimeError(f"{len(results)} results of {len(items)} items")
            except Exception as e:  # the error of each item
                results = [e] * len(items)
        answers = iter(results)
        for place, x in enumerate(held):
            r = next(answers) if x[1] is not None else None
            bad = isinstance(r, Exception)
            yield (*x, None if bad else r, (str(r) or type(r).__name__) if bad else None, lane, batch, place)

    def handleInputRows(self, key, rows, timerValues):
        yield from frames.in_frames(self._filled(key[0], rows, timerValues), _DONE)

    def _filled(self, lane: int, rows, timerValues) -> Iterator[tuple]:
        held = self._held()
        waiting, first = bool(held), self._batch()
        batch = first
        for t in frames.in_order(rows, ["partition", "offset", *_FIELDS], _order):
            held.append((_int(t[2]), _int(t[3]), _int(t[4]), t[5], t[6]))
            if len(held) == self.size:
                yield from self._done(lane, batch, held)
                held, waiting = [], False
                batch += 1
        if batch > first:
            self.count.update((batch,))
        self.open.clear()
        if held:
            self.open.put(held)
        if not waiting:
            self._disarm()
            if held:
                at = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
                self.due.update((at,))
                self.handle.registerTimer(at)

    def _held(self) -> list[tuple]:
        """Items of the open batch, as tuples with bytes."""
        found = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        return [(*x[:3], None if x[3] is None else bytes(x[3]), None if x[4] is None else bytes(x[4])) for x in found]

    def _disarm(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
            held, batch = self._held(), self._batch()
            self.open.clear()
            self.count.update((batch + 1,))
            yield from frames.in_frames(self._done(key[0], batch, held), _DONE)

    def close(self) -> None:
        pass


def in_batches(items: DataFrame, execute: Execute, size: int, delay_ms: int = DELAY_MS, lanes: int = 16, lane: Column | None = None) -> DataFrame:
    """The stream of settled items (DONE) of a stream of items: partition and offset of the event's record, event, item_ix (null for an event
    without items), n_items, key, value. Items of all partitions and keys go into one batch; up to `lanes` batches run at a time. lane: of
    a key, a hash unless given. asynchronous.completed says which events are done, their callbacks due."""
    if size < 1 or lanes < 1 or delay_ms < 1:
        raise ValueError("size, lanes and delay_ms must be 1 or more")
    own = F.pmod(F.xxhash64("key") if lane is None else lane, F.lit(lanes)).cast("int")
    # Numbers that may be null go as strings, for with nulls they come as floats.
    numbers = [F.col(c).cast("string").alias(c) for c in ("event", "item_ix", "n_items")]
    rows = items.select(own.alias("lane"), "partition", "offset", *numbers, "key", "value")
    return rows.groupBy("lane").transformWithStateInPandas(Batcher(execute, size, delay_ms), DONE, "Append", "ProcessingTime")
