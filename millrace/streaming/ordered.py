"""Ordered state: keys of a group in the order of their bytes, in blocks of bounded size, and a queue with two ends over it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

#: Keys of a block, at most.
BLOCK = 128
BLOCKS, INDEX = ("block bigint", "keys array<binary>, vals array<binary>"), "lows array<binary>, ids array<bigint>, fresh bigint, n bigint"


def sortable(x: int) -> bytes:
    """9 bytes whose order is that of the integers of 64 bits (the sortable codec's form)."""
    return bytes([x >= 0]) + (x & (1 << 64) - 1).to_bytes(8)


def unsorted(raw: bytes) -> int:
    return int.from_bytes(raw[1:9]) - (0 if raw[0] else 1 << 64)


class Sorted:
    """A map in key order: get, put, delete, both ends, the next key, ranges. An operation reads and writes a block or two, and the index,
    which has a key for each block; blocks have between a quarter of BLOCK and BLOCK keys, but for the last that is left."""

    def __init__(self, blocks: Any, index: Any, size: int = BLOCK):
        if size < 4:
            raise ValueError("a block has 4 keys or more")
        self._blocks, self._state, self.size = blocks, index, size
        lows, ids, self._fresh, self._n = index.get() if index.exists() else ([], [], 0, 0)
        self._lows, self._ids = [bytes(x) for x in lows], list(ids)

    def __len__(self) -> int:
        return self._n

    def _load(self, i: int) -> tuple[list[bytes], list[bytes]]:
        keys, values = self._blocks.getValue((self._ids[i],))
        if isinstance(keys, list) and isinstance(keys[0], bytes) and isinstance(values[0], bytes):
            return keys, values  # as they were saved: what changes them saves them again
        return [bytes(x) for x in keys], [bytes(x) for x in values]

    def _save(self, i: int, keys: list[bytes], values: list[bytes]) -> None:
        self._lows[i] = keys[0]
        self._blocks.updateValue((self._ids[i],), (keys, values))

    def _told(self) -> None:
        self._state.update((self._lows, self._ids, self._fresh, self._n))

    def _new(self, i: int, keys: list[bytes], values: list[bytes]) -> None:
        self._lows.insert(i, keys[0])
        self._ids.insert(i, self._fresh)
        self._fresh += 1
        self._save(i, keys, values)

    def _drop(self, i: int) -> None:
        self._blocks.removeKey((self._ids[i],))
        del self._lows[i], self._ids[i]

    def _of(self, key: bytes) -> int:
        return max(0, bisect_right(self._lows, key) - 1)

    def get(self, key: bytes) -> bytes | None:
        if not self._ids:
            return None
        keys, values = self._load(self._of(key))
        k = bisect_left(keys, key)
        return values[k] if k < len(keys) and keys[k] == key else None

    def put(self, key: bytes, value: bytes) -> None:
        if not self._ids:
            self._new(0, [key], [value])
            self._n = 1
        else:
            i = self._of(key)
            keys, values = self._load(i)
            k = bisect_left(keys, key)
            if k < len(keys) and keys[k] == key:
                values[k] = value
                self._save(i, keys, values)
                return
            keys.insert(k, key)
            values.insert(k, value)
            self._n += 1
            if len(keys) > self.size:
                half = len(keys) // 2
                self._new(i + 1, keys[half:], values[half:])
                keys, values = keys[:half], values[:half]
            self._save(i, keys, values)
        self._told()

    def delete(self, key: bytes) -> bytes | None:
        """The value that was there."""
        if not self._ids:
            return None
        i = self._of(key)
        keys, values = self._load(i)
        k = bisect_left(keys, key)
        if k == len(keys) or keys[k] != key:
            return None
        old = values.pop(k)
        del keys[k]
        self._n -= 1
        if len(keys) < self.size // 4 and len(self._ids) > 1:
            # Together with a neighbour; what is too much for one block is two halves.
            j = i + 1 if i + 1 < len(self._ids) else i - 1
            more = self._load(j)
            low = min(i, j)
            keys, values = (keys + more[0], values + more[1]) if i < j else (more[0] + keys, more[1] + values)
            self._drop(low + 1)
            if len(keys) > self.size:
                half = len(keys) // 2
                self._save(low, keys[:half], values[:half])
                self._new(low + 1, keys[half:], values[half:])
            else:
                self._save(low, keys, values)
        elif keys:
            self._save(i, keys, values)
        else:
            self._drop(i)
        self._told()
        return old

    def first(self) -> tuple[bytes, bytes] | None:
        if not self._ids:
            return None
        keys, values = self._load(0)
        return keys[0], values[0]

    def last(self) -> tuple[bytes, bytes] | None:
        if not self._ids:
            return None
        keys, values = self._load(len(self._ids) - 1)
        return keys[-1], values[-1]

    def next(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The least key above this one."""
        return next(self.range(key + b"\0"), None)

    def range(self, low: bytes = b"", high: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Keys from low up to, and without, high; a block at a time. The map may not change meanwhile."""
        for i in range(self._of(low), len(self._ids)):
            if high is not None and self._lows[i] >= high:
                return
            keys, values = self._load(i)
            for k in range(bisect_left(keys, low), len(keys) if high is None else bisect_left(keys, high)):
                yield keys[k], values[k]


class Places:
    """A sorted map as the map state that a queue finds its items by: whether an item is there is seen in its block, which is held with those of
    other items, and asks nothing of the state for an item that is new."""

    def __init__(self, own: Sorted):
        self._own = own

    def containsKey(self, key: tuple) -> bool:
        return self._own.get(key[0]) is not None

    def getValue(self, key: tuple) -> tuple | None:
        found = self._own.get(key[0])
        return None if found is None else (found,)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._own.put(key[0], value[0])

    def removeKey(self, key: tuple) -> None:
        self._own.delete(key[0])


class Queue:
    """A queue with two ends: items with a priority each, least and greatest first; of equal ones, by their ids."""

    def __init__(self, ordered: Sorted, places: Any):
        self.ordered, self._places = ordered, places

    def __len__(self) -> int:
        return len(self.ordered)

    def push(self, item: bytes, priority: int, value: bytes = b"") -> None:
        """A new item, or another priority and value for one that is there."""
        self.remove(item)
        at = sortable(priority)
        self.ordered.put(at + item, value)
        self._places.updateValue((item,), (at,))

    def remove(self, item: bytes) -> bool:
        if not self._places.containsKey((item,)):
            return False
        self.ordered.delete(bytes(self._places.getValue((item,))[0]) + item)
        self._places.removeKey((item,))
        return True

    def _told(self, found: tuple[bytes, bytes] | None) -> tuple[bytes, int, bytes] | None:
        return None if found is None else (found[0][9:], unsorted(found[0]), found[1])

    def least(self) -> tuple[bytes, int, bytes] | None:
        """(item, priority, value)."""
        return self._told(self.ordered.first())

    def greatest(self) -> tuple[bytes, int, bytes] | None:
        return self._told(self.ordered.last())

    def pop_least(self) -> tuple[bytes, int, bytes] | None:
        if (found := self.least()) is not None:
            self.remove(found[0])
        return found

    def pop_greatest(self) -> tuple[bytes, int, bytes] | None:
        if (found := self.greatest()) is not None:
            self.remove(found[0])
        return found
