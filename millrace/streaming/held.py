"""State of a group, held while its rows are handled: each entry is read once and written once, however often handlers come to it.

A call to Spark's state is a message to another process and its answer, which costs far more than handling a record. What is held is
bounded in bytes: beyond that all is written and read again where it is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

#: Bytes that a group holds of its state, about.
MOST = 48_000_000
#: Records after which it is looked at again.
EVERY = 16
#: Bytes of an entry beside its own.
ENTRY = 250


def _size(value: tuple | None) -> int:
    """About the bytes of a value with bytes or lists of bytes."""
    size = ENTRY
    for x in value or ():
        if isinstance(x, list):
            size += 60 * len(x) + sum(map(len, x))
        elif x is not None:
            size += len(x)
    return size


class Held:
    """A map state with its own interface. sure: what is asked for is there. flat: entries are small, or are counted elsewhere."""

    def __init__(self, state: Any, sure: bool = False, flat: bool = False):
        self._state, self._sure, self._flat = state, sure, flat
        self._own: dict[tuple, tuple | None] = {}
        self._sizes: dict[tuple, int] = {}
        self._changed: set[tuple] = set()
        #: Keys that the state does not have.
        self._absent: set[tuple] = set()
        #: Bytes that are held.
        self.size = 0

    def _keep(self, key: tuple, value: tuple | None) -> None:
        self._own[key] = value
        size = ENTRY if self._flat else _size(value)
        self.size += size - self._sizes.get(key, 0)
        self._sizes[key] = size

    def getValue(self, key: tuple, new: bool = False) -> tuple | None:
        """None if it is not there, which `new` says of what is not held."""
        if key not in self._own:
            found = self._state.getValue(key) if not new and (self._sure or self._state.containsKey(key)) else None
            if found is None:
                self._absent.add(key)
            self._keep(key, found)
        return self._own[key]

    def containsKey(self, key: tuple, new: bool = False) -> bool:
        return self.getValue(key, new) is not None

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._keep(key, value)
        self._changed.add(key)

    def removeKey(self, key: tuple) -> None:
        self._keep(key, None)
        self._changed.add(key)

    def keys(self) -> Iterator[tuple]:
        """All keys, also those that are held only."""
        self.write()
        return iter([tuple(k) for k in self._state.keys()])

    def write(self) -> None:
        for key in self._changed:
            value = self._own[key]
            if value is not None:
                self._state.updateValue(key, tuple(value))
                self._absent.discard(key)
            elif key not in self._absent:
                self._state.removeKey(key)
                self._absent.add(key)
        self._changed.clear()

    def drop(self) -> None:
        """Write, and hold nothing."""
        self.write()
        self._own.clear()
        self._sizes.clear()
        self._absent.clear()
        self.size = 0


class Part:
    """The part of a held map whose keys begin with `first`; new: nothing of it is in the state yet."""

    def __init__(self, held: Held, first: tuple, new: bool = False):
        self._held, self._first, self._new = held, first, new

    def getValue(self, key: tuple) -> tuple | None:
        return self._held.getValue((*self._first, *key), self._new)

    def containsKey(self, key: tuple) -> bool:
        return self.getValue(key) is not None

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._held.updateValue((*self._first, *key), value)

    def removeKey(self, key: tuple) -> None:
        self._held.removeKey((*self._first, *key))

    def keys(self) -> Iterator[tuple]:
        n = len(self._first)
        return (k[n:] for k in self._held.keys() if tuple(bytes(x) for x in k[:n]) == self._first)


class Value:
    """An entry of a held map as a value state."""

    def __init__(self, held: Held, key: tuple, new: bool = False):
        self._held, self._key, self._new = held, key, new

    def exists(self) -> bool:
        return self.get() is not None

    def get(self) -> tuple | None:
        return self._held.getValue(self._key, self._new)

    def update(self, value: tuple) -> None:
        self._held.updateValue(self._key, value)


PENDING = "topic string, partition int, block bigint", "offsets array<bigint>, stages array<string>"


class Pending:
    """Which stage has the record at an offset of a topic's partition, in blocks of offsets."""

    #: Offsets of a block.
    BLOCK = 1024

    def __init__(self, state: Any):
        self._state = state
        self._own: dict[tuple, dict[int, str]] = {}
        self._changed: set[tuple] = set()

    @property
    def size(self) -> int:
        return len(self._own) * self.BLOCK * 100

    def _block(self, key: tuple) -> dict[int, str]:
        if key not in self._own:
            found = self._state.getValue(key) if self._state.containsKey(key) else ([], [])
            self._own[key] = dict(zip(*found, strict=True))
        return self._own[key]

    def get(self, at: tuple[str, int], offset: int) -> str | None:
        return self._block((*at, offset // self.BLOCK)).get(offset)

    def put(self, at: tuple[str, int], offset: int, stage: str) -> None:
        key = (*at, offset // self.BLOCK)
        self._block(key)[offset] = stage
        self._changed.add(key)

    def remove(self, at: tuple[str, int], offset: int) -> None:
        key = (*at, offset // self.BLOCK)
        self._block(key).pop(offset, None)
        self._changed.add(key)

    def write(self) -> None:
        for key in self._changed:
            if own := self._own[key]:
                self._state.updateValue(key, (list(own), list(own.values())))
            else:
                self._state.removeKey(key)
        self._changed.clear()

    def drop(self) -> None:
        self.write()
        self._own.clear()

    def lows(self) -> dict[tuple[str, int], int]:
        """The lowest offset that a stage has, of each topic and partition that has any."""
        self.write()
        first: dict[tuple[str, int], int] = {}
        for topic, part, block in self._state.keys():
            first[topic, part] = min(block, first.get((topic, part), block))
        return {at: min(self._block((*at, block))) for at, block in first.items()}
