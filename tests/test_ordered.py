"""Ordered state and its queue against plain sorted lists."""

import random

import pytest

from millrace.streaming import mocks
from millrace.streaming.ordered import Queue, Sorted, sortable, unsorted


class Blocks(mocks.MemoryState):
    """Counts what is touched."""

    touched = 0

    def getValue(self, key):
        self.touched += 1
        return super().getValue(key)


@pytest.mark.parametrize("size", [4, 7, 32])
def test_map_in_order(size):
    rng, plain, index, blocks = random.Random(size), {}, mocks.MemoryValue(), Blocks()
    own = Sorted(blocks, index, size)
    for step in range(6000):
        key = b"%03d" % rng.randrange(400)
        before = blocks.touched
        if rng.random() < (0.7 if step < 2500 else 0.35):
            own.put(key, b"%d" % step)
            plain[key] = b"%d" % step
        else:
            assert own.delete(key) == plain.pop(key, None)
        assert blocks.touched - before <= 2 and len(own) == len(plain)
        if step % 50 == 0:
            own = Sorted(blocks, index, size)  # as a later batch finds it
            keys = sorted(plain)
            assert [k for k, _ in own.range()] == keys
            a, b = sorted((b"%03d" % rng.randrange(400), b"%03d" % rng.randrange(400)))
            assert list(own.range(a, b)) == [(k, plain[k]) for k in keys if a <= k < b]
            assert own.first() == (keys and (keys[0], plain[keys[0]]) or None) and own.last() == (keys and (keys[-1], plain[keys[-1]]) or None)
            assert own.next(key) == next(((k, plain[k]) for k in keys if k > key), None) and own.get(key) == plain.get(key)
            sizes = [len(v[0]) for v in blocks.items.values()]
            assert max(sizes, default=0) <= size and len(sizes) <= max(1, len(plain) // (size // 4) + 1)


def test_queue_with_two_ends():
    rng, plain = random.Random(2), {}
    own, places = Sorted(Blocks(), mocks.MemoryValue(), 8), mocks.MemoryState()
    q = Queue(own, places)
    for step in range(4000):
        item, what = b"i%d" % rng.randrange(150), rng.random()
        if what < 0.5:
            priority = rng.randrange(-40, 40)
            q.push(item, priority, b"%d" % step)
            plain[item] = (priority, b"%d" % step)
        elif what < 0.6:
            assert q.remove(item) == (plain.pop(item, None) is not None)
        else:
            order = sorted((p, i) for i, (p, _) in plain.items())
            at = (order[0] if what < 0.8 else order[-1])[1] if order else None
            got = q.pop_least() if what < 0.8 else q.pop_greatest()
            assert got == (None if at is None else (at, *plain.pop(at)))
        assert len(q) == len(plain)
    assert len(places.items) == len(plain)


def test_sortable_integers():
    xs = [-(2**63), -256, -255, -2, -1, 0, 1, 10, 255, 256, 2**63 - 1]
    assert sorted(xs, key=sortable) == xs and [unsorted(sortable(x)) for x in xs] == xs
