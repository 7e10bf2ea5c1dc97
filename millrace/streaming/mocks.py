"""Contexts for tests of handlers: a store in memory, and what a handler put out, without a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row

from .processor import Context


class MemoryState:
    """The part of a map state that contexts use."""

    def __init__(self, items: dict[bytes, bytes] | None = None):
        self.items = {(k,): (v, "") for k, v in (items or {}).items()}

    def containsKey(self, key: tuple) -> bool:
        return key in self.items

    def getValue(self, key: tuple) -> tuple | None:
        return self.items.get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.items[key] = value

    def removeKey(self, key: tuple) -> None:
        self.items.pop(key, None)

    def keys(self) -> Iterator[tuple]:
        return iter(list(self.items))


class MemoryValue:
    """The part of a value state that ordered state uses."""

    def __init__(self):
        self.value = None

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value


def context(key: bytes, value: bytes | None = None, kind: str = "", items: dict[bytes, bytes] | None = None, partition: int = 0, offset: int = 0, topic: str = "test", state: MemoryState | None = None) -> Context:
    """A context of one record over a store of `items`, or over the state of an earlier context. Its outputs are in `rows`."""
    record = Row(topic=topic, partition=partition, offset=offset, key=key, value=value, record_type=kind)
    return Context(partition, record, MemoryState(items) if state is None else state, topic)


def interjection(items: dict[bytes, bytes] | None = None, partition: int = 0, topic: str = "test", state: MemoryState | None = None) -> Context:
    """A context without a record, as a timer gets it."""
    return Context(partition, None, MemoryState(items) if state is None else state, topic)


def forwarded(ctx: Context) -> list[tuple[str, bytes, bytes | None]]:
    """(topic, key, value) of what the handler forwarded, in order."""
    return [(r.topic, r.key, r.value) for r in ctx.rows if r.out == "forward"]


def changes(ctx: Context) -> list[tuple[bytes, bytes | None]]:
    """(key, value) of the change-log entries, in order; a deletion has no value."""
    return [(r.key, r.value) for r in ctx.rows if r.out == "changelog"]
