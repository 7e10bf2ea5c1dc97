"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document is its set of distinct five-word shingles (64-bit hashes). Two sets of sizes s and t with Jaccard similarity of
at least 3/4 differ in at most H = (s + t) / 7 elements. Sizes are cut into bands, wider than 4/3, so that linked sets lie in
one band or in neighbouring ones; a set takes part in its own band and, if a partner can lie there, in the next. A band
divides the domain of hashes into blocks of three partitions, and each block gives a signature for each of its subsets of two
partitions: what the set has in them. Of M = H / 2 + 1 blocks (rounded down), one has at most one differing element, so that two of
its partitions agree and the pair shares their signature.

A signature of two empty partitions would be everyone's, so it is no signature, and a block counts only if all three of its
subsets give one. A set gives the signatures of all blocks up to its M-th that counts: of a linked pair, the one whose blocks end
first shares one of them with the other. A set of fewer than M such blocks (a short text) goes on to further divisions of the domain. Whether
a signature is used depends on itself only, so the argument holds as well where signatures are passed over (below).

Equal sets are one node from the start. Groups of signatures are read in sorted order, as a stream, and nothing is
expanded into all pairs:

1. Each group's members are verified against its pivot, the least one; links make components. Groups with one pivot count as one
   from then on.
2. Where groups still in several components would need a large comparison (a passage that very many documents share), their
   signatures are passed over: members give signatures anew without those, for WIDE_ROUNDS rounds. Members that lack M blocks stay.
3. In the groups left in several components, what is apart from a group's largest component meets the other members in
   cells of bounded size that tasks get by a shuffle: first the closest few pairs of each two components, then all pairs of
   components that are still different.

Before whole sets are compared, pairs meet a bound: a bitmap of each set, of 4 to 8 bits an element, from which the
intersection can be no larger than the common bits and the elements that share a bit. Sizes of rounds, cells and groups decide
the cost, never the result. Components follow by connected_components().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, connected_components, settle
from .encoders import hand_back, slices

WIDTH, RATIO, SPARE = 5, 2.0, 1.1
#: Partitions of a block, and its subsets of two.
BLOCK, SUBSETS = 3, ((0, 1), (0, 2), (1, 2))
#: Divisions of the domain that a set tries when signatures are passed over; rounds of that; how many are passed over in all.
DIVISIONS, WIDE_ROUNDS, MOST_WIDE = 4, 2, 100_000
#: Pairs of a group above which its signature is passed over. Members of a cell, on each side.
WIDE_PAIRS, CELL = 100_000_000, 8_192
#: Pairs of two components that a cell gives at first, before all pairs of those that are still apart.
FEW = 2
#: Members up to which a group is told once in a task and never passed over; members of a row; members of which a task holds a group.
SMALL, CHUNK, PART = 24, 4_096, 200_000
BROADCAST_ROWS = 500_000
#: Bytes above which a word is hashed by itself; characters of texts whose sets are made at once; blocks whose signatures are.
LONG_WORD, STEP_CHARS, STEP_BLOCKS = 64, 500_000, 8_000
#: Bytes of bitmaps compared at once; bytes of texts, bitmaps or sets that go to a worker at once.
STEP_BYTES, BATCH_BYTES = 4_000_000, 8_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    x = y >> np.uint64(27)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    y = x >> np.uint64(31)
    y ^= x
    return y


#: Bytes as words see them: A-Z lowered, what is no part of a word a space. What counts of eight bytes, by the bytes left of a word.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_KEEP = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time; long ones by xxHash. Eight more bytes follow the last word."""
    import xxhash

    size = end - start
    eight, h = sliding_window_view(low, 8), mix(size.astype(np.uint64) * ODD)
    at = np.arange(len(h))
    for k in range(0, LONG_WORD, 8):
        if k:
            at = at[size[at] > k]
        if not len(at):
            break
        h[at] = mix(h[at] * ODD + (eight[start[at] + k].view("<u8")[:, 0] & _KEEP[np.minimum(size[at] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(low[start[i] : end[i]].tobytes())
    return h


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: words of A-Z lowered, five by five; fewer words are one shingle."""
    if not len(texts):
        return []
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(at[-1] - at[0])
    if not size:
        return [np.empty(0, dtype=np.uint64)] * len(texts)
    low = np.full(size + 8, 32, dtype=np.uint8)
    low[:size] = _FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    word = low != 32
    edge = np.zeros(size + 1, dtype=bool)  # a word ends with its text
    edge[at] = True
    start = np.flatnonzero(word[:size] & (edge[:size] | ~np.concatenate([[False], word[: size - 1]])))
    end = np.flatnonzero(word[:size] & (edge[1:] | ~word[1 : size + 1])) + 1
    h = _hashes(low, start, end)
    first = np.searchsorted(start, at)
    out = np.full(len(h), WIDTH, dtype=np.uint64)
    for k in range(min(WIDTH, len(h))):
        out[: len(h) - k] = out[: len(h) - k] * ODD + h[k:]
    bounds = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    for a, b in bounds:
        if a < b < a + WIDTH:
            x = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                x = x * ODD + h[k]
            out[a] = x[0]
    out, sets = mix(out), []
    for a, b in bounds:
        u = out[a : max(a + 1, b - WIDTH + 1)] if a < b else out[:0]
        u.sort()
        new = u[1:] != u[:-1]
        sets.append(u if new.all() else u[np.concatenate([[True], new])])
    return sets


def node_of(u: np.ndarray) -> int:
    """The signed 64-bit digest of a set, and so of all rows with that set."""
    import xxhash

    d = xxhash.xxh3_64_intdigest(u.tobytes())
    return d - (d >> 63 << 64)


def bitmap(u: np.ndarray) -> bytes:
    """A bit for each element, at its lowest bits; a power of two of bits, at least four for each element."""
    n = 1 << max(6, (4 * len(u) - 1).bit_length())
    bits = np.zeros(n, dtype=np.uint8)
    bits[(u & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(p: bytes, q: bytes, n_p: int, n_q: int) -> int:
    """What two sets can have in common at most, by their bitmaps and sizes. The longer one is folded: its halves
    are where the next lower bit differs."""
    x, y = (np.frombuffer(b, np.uint8) for b in (p, q))
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    count = lambda b: int(np.bitwise_count(b).sum())
    return count(x & y) + min(n_p - count(x), n_q - count(y))


def bands(most: int = 1 << 40) -> list[tuple[int, int]]:
    """(least, greatest) size of each band."""
    out, low = [], 1
    while low <= most:
        high = max(low + 1, int(low * RATIO)) if low > 1 else 1
        out.append((low, high))
        low = high + 1
    return out


BANDS = bands()
_TOPS = np.array([b[1] for b in BANDS], dtype=np.int64)


def places(s: int) -> list[tuple[int, int, int]]:
    """(band, blocks, blocks that must count) for a set of size s: its own band, and the next if a linked set can lie there. A
    band where only an equal set can be linked is left out."""
    b, most, out = int(np.searchsorted(_TOPS, s)), 4 * s // 3, []
    for k in (b, b + 1):
        low, high = BANDS[k]
        differ = (s + min(high, most)) // 7
        if differ and (k == b or most >= low):
            out.append((k, max(2, int(np.ceil(SPARE * (2 * high // 14 + 1)))), differ // 2 + 1))
    return out


def _subsets(u: np.ndarray, blocks: int, tag: int, need: int, wide: np.ndarray | None) -> tuple[np.ndarray, bool]:
    """_subsets_of() one set."""
    found, _, enough = _subsets_of([u], blocks, tag, np.array([need]), wide)
    return found, bool(enough[0])


def _subsets_of(sets: list[np.ndarray], blocks: int, tag: int, need: np.ndarray, wide: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets, side by side, each set's of the blocks up to the `need`-th that counts; how many each has, and
    whether so many blocks do. A set ascends, so partitions are runs. wide: signatures, in order, that are passed over."""
    n = blocks * BLOCK
    u = np.concatenate(sets)
    at = ((u >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    at += np.repeat(np.arange(len(sets)) * n, [len(s) for s in sets])
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sums = np.zeros(len(sets) * n, dtype=np.uint64)
    sums[at[start]] = np.add.reduceat(mix(u + np.uint64(0x632BE59BD9B4E019)), start)
    part = sums.reshape(len(sets), blocks, BLOCK)
    one, two = part[:, :, [i for i, _ in SUBSETS]], part[:, :, [j for _, j in SUBSETS]]
    use = (one | two) != 0
    k = np.arange(len(SUBSETS), dtype=np.uint64)
    own = mix(np.arange(blocks, dtype=np.uint64)[:, None] * ODD + (k + np.uint64(4 * tag)))
    one += (np.uint64(2) * k + np.uint64(1)) * ODD
    two *= ODD
    found = mix(one)
    found += two
    found += own
    found = mix(found)
    if wide is not None and len(wide):
        use &= wide[np.minimum(np.searchsorted(wide, found), len(wide) - 1)] != found
    counted = np.cumsum(use.all(axis=2), axis=1)
    end = (counted < need[:, None]).sum(axis=1) + 1
    use &= (np.arange(blocks) < end[:, None])[:, :, None]
    return found[use], use.sum(axis=(1, 2)), end <= blocks


def _division(u: np.ndarray, t: int) -> np.ndarray:
    """The set as the t-th division of the domain sees it."""
    return u if not t else np.sort(mix(u ^ mix(np.array([t], dtype=np.uint64))))


def signatures(u: np.ndarray, wide: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """signatures_of() one set."""
    (found,), (short,) = signatures_of([u], wide)
    return found, short


def signatures_of(sets: list[np.ndarray], wide: np.ndarray | None = None) -> tuple[list[np.ndarray], list[bool]]:
    """All signatures of each set, as signed 64-bit integers, and whether a band lacks blocks that count under every division
    tried, which is so only where signatures are passed over. Linked sets share one, or both lack. Sets of a band go together."""
    out, short = [[np.empty(0, dtype=np.uint64)] for _ in sets], [False] * len(sets)
    of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, u in enumerate(sets):
        for band, blocks, need in places(len(u)):
            of.setdefault((band, blocks), []).append((i, need))
    for (band, blocks), left in of.items():
        t, step = 0, max(1, STEP_BLOCKS // blocks)
        while left:
            more = []
            for k in range(0, len(left), step):
                some = left[k : k + step]
                found, count, enough = _subsets_of([_division(sets[i], t) for i, _ in some], blocks, band << 8 | min(t, 255), np.array([n for _, n in some]), wide)
                for (i, _), x in zip(some, np.split(found, np.cumsum(count)[:-1]), strict=True):
                    out[i].append(x)
                more += [x for x, e in zip(some, enough.tolist(), strict=True) if not e]
            left, t = more, t + 1
            if wide is not None and t == DIVISIONS:
                for i, _ in left:
                    short[i] = True
                break
    return [np.concatenate(x).view(np.int64) for x in out], short


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, node, bits, of_text) of each row: size, digest and bitmap of its set, a task gives a node's bitmap once."""
    seen: set[int] = set()
    for b in slices(batches, chars=STEP_CHARS):
        got = []
        for d, u, x in zip(b.column("doc_id").to_pylist(), shingles(b.column("text")), b.column("of_text").to_pylist(), strict=True):
            node = node_of(u)
            got.append((d, len(u), node, None if node in seen else bitmap(u), x))
            seen.add(node)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=["doc_id", "n", "node", "bits", "of_text"])
    hand_back()


def _sign(shared):
    """(node, sigs, short) of each set; shared: signatures to pass over, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, seen = shared.value, set()
        for b in slices(batches, chars=STEP_CHARS):
            new = {}
            for u in shingles(b.column("text")):
                if len(u) and (node := node_of(u)) not in seen:
                    seen.add(node)
                    new[node] = u
            if new:
                nodes, (sigs, short) = list(new), signatures_of(list(new.values()), wide)
                ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs))), pa.array(short, pa.bool_())], names=["node", "sigs", "short"])
        hand_back()

    return run


def _digest(b: bytes) -> int:
    import xxhash

    d = xxhash.xxh3_64_intdigest(b)
    return d - (d >> 63 << 64)


GROUPS = "sig long, pivot long, members array<long>"


def _gather(chunk: int = CHUNK, part: int = PART):
    """(sig, pivot, members) of each signature that two nodes share, from rows in order of sig. pivot: one of the members, the
    least of up to `part`. A group of more than `chunk` members has several rows, with one pivot. Of small groups with the same
    members a task gives one. What is held of a group of any size is `part` members and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        left_s, left_n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        begun: int | None = None  # pivot of the first group of what is left, if part of it has been told

        def groups(s, n, begun, goes_on=False):
            """A batch of rows, if any, and the last group's pivot."""
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            end = np.append(start[1:], len(s))
            pick = end - start > 1
            pick[0] |= begun is not None
            rows, pivot = [], None
            for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True):
                m, sig = np.unique(n[a:b]), int(s[a])
                carried = begun if a == 0 else None
                if len(m) == 1 and carried is None and not goes_on:
                    continue
                pivot = int(m[0]) if carried is None else carried
                if len(m) <= SMALL and carried is None and not goes_on:
                    if (key := _digest(m.tobytes())) in told:
                        continue
                    if len(told) > 300_000:
                        told.clear()
                    told.add(key)
                rows += [(sig, pivot, m[x : x + chunk]) for x in range(0, len(m), chunk)]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sig", "pivot", "members"]) if rows else None, pivot

        for b in batches:
            s = np.concatenate([left_s, b.column(0).to_numpy(zero_copy_only=False)])
            n = np.concatenate([left_n, b.column(1).to_numpy(zero_copy_only=False)])
            if not len(s):
                continue
            last = int(np.searchsorted(s, s[-1]))  # the last group may go on
            if last:
                out, _ = groups(s[:last], n[:last], begun)
                begun = None
                if out is not None:
                    yield out
            left_s, left_n = s[last:], n[last:]
            if len(left_s) > part:
                out, begun = groups(left_s, left_n, begun, goes_on=True)
                yield out
                left_s, left_n = left_s[:0], left_n[:0]
            if begun is not None and not len(left_s):
                left_s, left_n = s[-1:], np.array([begun])  # its place is kept by its pivot
        if len(left_s):
            out, _ = groups(left_s, left_n, begun)
            if out is not None:
                yield out
        told.clear()
        hand_back()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for b in slices(batches, chars=STEP_CHARS):
        out = {}
        for u in shingles(b.column("text")):
            node = node_of(u)
            if node not in seen:
                seen.add(node)
                out[node] = u.tobytes()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["node", "items"])
    hand_back()


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets may be similar enough, by what they can have in common."""
    for b in batches:
        keep = []
        for n, m, p, q in zip(*(b.column(c).to_pylist() for c in ("n_a", "n_b", "p", "q")), strict=True):
            inter = most_common(p, q, n, m)
            keep.append(100 * inter >= 75 * (n + m - inter))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        links = []
        for x, y, p, q in zip(*(b.column(c).to_pylist() for c in ("a", "b", "p", "q")), strict=True):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.concatenate([u, v])
            both.sort(kind="stable")
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= 75 * (len(u) + len(v) - inter):
                links.append((x, y))
        if links:
            a, c = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps, a row each, folded to `width` words."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def _closest(found: list[tuple[np.ndarray, ...]], c: np.ndarray, few: int) -> list[tuple[np.ndarray, ...]]:
    """Of pairs (places, places, bound of similarity), the first few of each two components, the most similar first."""
    i, j, near = (np.concatenate(x) for x in zip(*found, strict=True))
    low, high = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
    order = np.lexsort((-near, high, low))
    low, high = low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    at = np.arange(len(order))
    pick = order[at - np.maximum.accumulate(np.where(new, at, 0)) < few]
    return [(i[pick], j[pick], near[pick])]


def _similar(side: np.ndarray, node: np.ndarray, c: np.ndarray, n: np.ndarray, bits: list[bytes], few: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of a cell that the bound admits: side 0 with 1, and with 0 of other components; side 2 with 3. few: only
    so many of each two components."""
    width = np.array([len(b) for b in bits]) // 8
    by = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    maps = {w: np.frombuffer(b"".join([bits[i] for i in at.tolist()]), "<u8").reshape(len(at), w) for w, at in by.items()}
    out = []
    for wa, at in by.items():
        mine = side[at] % 2 == 0
        a, xs = at[mine], maps[wa][mine]
        if not len(a):
            continue
        for wb in (wa // 2, wa, 2 * wa):
            if wb not in by:
                continue
            b, w = by[wb], min(wa, wb)
            x, y = _folded(xs, w), _folded(maps[wb], w)
            spare_x = n[a] - np.bitwise_count(x).sum(1, dtype=np.int64)
            spare_y = n[b] - np.bitwise_count(y).sum(1, dtype=np.int64)
            step = max(1, STEP_BYTES // (8 * w * len(b)))
            for k in range(0, len(a), step):
                common = np.bitwise_count(x[k : k + step, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
                p = a[k : k + step, None]
                most = common + np.minimum(spare_x[k : k + step, None], spare_y[None, :])
                ok = (100 * most >= 75 * (n[p] + n[b] - most)) & (c[p] != c[b]) & ((side[b] == side[p] + 1) | (side[p] == 0) & (side[b] == 0) & (node[p] < node[b]))
                i, j = np.nonzero(ok)
                if len(i):
                    both = most[i, j]
                    out.append((a[k + i], b[j], both / (n[a[k + i]] + n[b[j]] - both)))
                    if few:
                        out = _closest(out, c, few)
    return [(node[i], node[j]) for i, j, _ in out]


def _cells(few: int | None):
    """Pairs (a, b) of the cells whose rows (g, i, j, side, node, c, n, bits) come side by side; a task gives a pair once, as far
    as it remembers. few: see _similar()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()

        def pairs(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
            side, node, c, n = (t.column(x).to_numpy() for x in ("side", "node", "c", "n"))
            return _similar(side, node, c, n, t.column("bits").to_pylist(), few)

        def batch(found):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            new = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) - told
            if len(told) > 200_000:
                told.clear()
            told.update(new)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

        left: list[pa.Table] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            key = np.stack([t.column(x).to_numpy() for x in ("g", "i", "j")], axis=1)
            found = []
            if left and tuple(key[0]) != last:
                found += pairs(pa.concat_tables(left))
                left = []
            ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), t.num_rows]
            for lo, hi in zip([0, *ends], ends, strict=False):
                left.append(t.slice(lo, hi - lo))
                if hi < t.num_rows:
                    found += pairs(pa.concat_tables(left))
                    left = []
            last = tuple(key[-1])
            if found:
                yield batch(found)
        if left and (found := pairs(pa.concat_tables(left))):
            yield batch(found)
        hand_back()

    return run


def _pairs(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set and the smallest doc_id that links reach from it.

    docs needs doc_id and text; other columns are not looked at. A null text, or one without words, is an empty set,
    linked with nothing. Rows with equal sets are linked; so are repeated rows. Rows without doc_id have no part in links;
    their component is null. An empty table gives an empty result.
    """
    return _labelled(docs).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame) -> DataFrame:
    """The rows of components(), with a hash of the text and with c, which tells components apart that have their smallest
    doc_id in common; c is null for rows that are linked with nothing."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        told, found = _found(docs)
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    rows = told.select("doc_id", F.col("n").alias("n_shingles"), "node", "of_text")
    return rows.join(found, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"), "of_text", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("c"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The described rows; (node, c, component_id)."""
    told = settle(docs.withColumn("of_text", F.xxhash64("text")).mapInArrow(_describe, "doc_id long, n long, node long, bits binary, of_text long"), "described")
    nodes = told.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        nodes = scratch.settle(nodes, "nodes")
        labels = _joined(docs.where("doc_id is not null"), told, nodes, scratch)
        of = scratch.settle(nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c")), "labels")
        least = of.groupBy("c").agg(F.min("rep").alias("component_id"))
        found = settle(of.join(least, "c").select("node", "c", "component_id"), "found")
    return told, found


def _joined(docs: DataFrame, told: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes that have links."""
    spark, shape = docs.sparkSession, "node long, sigs array<long>, short boolean"

    def signed(texts: DataFrame, wide: np.ndarray | None) -> DataFrame:
        return texts.mapInArrow(_sign(spark.sparkContext.broadcast(wide)), shape)

    def gathered(signed: DataFrame) -> DataFrame:
        rows = signed.select(F.explode("sigs").alias("sig"), "node").repartition("sig").sortWithinPartitions("sig")
        return scratch.settle(rows.mapInArrow(_gather(CHUNK, PART), GROUPS), "groups")

    groups = gathered(signed(docs.select("text"), None))
    # Its shuffle is the largest by far: its files go now, and not when the driver's memory happens to be full.
    spark._jvm.System.gc()
    member = groups.select(F.explode("members").alias("node")).union(groups.select("pivot")).distinct()
    sketch = told.where("bits is not null").join(member, "node", "left_semi").groupBy("node").agg(F.max("bits").alias("bits")).join(nodes, "node")
    sketch = scratch.settle(sketch.select("node", "rep", "n", "bits"), "sketches")
    tried: list[DataFrame] = []

    def texts_of(some: DataFrame) -> DataFrame:
        """One text of each of some nodes."""
        wanted = scratch.settle(some.join(sketch, "node").select("rep").distinct(), "wanted")
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return docs.join(few, docs.doc_id == wanted.rep, "left_semi").select("text")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, of those that are new, by their whole sets, which are made anew."""
        pairs = scratch.settle(reduce(lambda d, t: d.join(t, ["a", "b"], "left_anti"), tried, pairs), "pairs")
        tried.append(pairs)
        sets = scratch.settle(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()).mapInArrow(_sets, "node long, items binary"), "sets")
        x, y = (sets.select(F.col("node").alias(c), F.col("items").alias(p)) for c, p in (("a", "p"), ("b", "q")))
        return scratch.settle(pairs.join(x, "a").join(y, "b").mapInArrow(_test, "a long, b long"), "links")

    def stars(groups: DataFrame) -> DataFrame:
        """(g, node) of each group's members, without its pivot g: groups of one pivot are one from here on."""
        return scratch.settle(groups.select(F.col("pivot").alias("g"), F.explode("members").alias("node")).where("g <> node").distinct(), "stars")

    def first_links(star: DataFrame) -> DataFrame:
        """Links of members with their pivots."""
        x, y = (sketch.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(p)) for c, p in (("a", "p"), ("b", "q")))
        close = star.select(*_pairs("g", "node")).distinct().join(x, "a").join(y, "b").where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
        return verified(close.mapInArrow(_bound, "a long, b long"))

    def labelled(links: list[DataFrame]) -> DataFrame:
        return connected_components(reduce(DataFrame.union, links), settle=scratch.settle)

    def mixed(star: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(g, node, c) of all groups; (g, top, n, apart) of those in several components, top the largest."""
        m = star.union(star.select("g", F.col("g").alias("node")).distinct()).join(labels, "node", "left")
        m = scratch.settle(m.select("g", "node", F.coalesce("component", "node").alias("c")), "members")
        of = m.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("most")).where("n > 2 and most.n < n")
        return m, scratch.settle(of.select("g", F.col("most.c").alias("top"), "n", (F.col("n") - F.col("most.n")).alias("apart")), "mixed")

    def inside(m: DataFrame, of: DataFrame, few: int | None) -> DataFrame:
        """Links between components of the same group, of the closest few pairs of each two in a cell, or of all pairs."""
        m = m.join(of, "g").withColumn("out", F.col("c") != F.col("top"))
        one = m.where(F.col("n") <= CELL).select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("out"), 0).otherwise(1).alias("side"), "node", "c")
        more = m.where(F.col("n") > CELL)
        cells = lambda c: F.ceil(F.col(c) / CELL).cast("int")
        salt = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), cells(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), cells(c) - 1))
        apart = more.where("out").select("g", salt("apart").alias("i"), each("n").alias("j"), F.lit(2).alias("side"), "node", "c")
        whole = more.select("g", each("apart").alias("i"), salt("n").alias("j"), F.lit(3).alias("side"), "node", "c")
        rows = one.union(apart).union(whole).join(sketch.select("node", "n", "bits"), "node")
        found = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_cells(few), "a long, b long")
        return verified(found.distinct())

    star = stars(groups)
    links = [first_links(star)]
    labels = labelled(links)
    m, of = mixed(star, labels)
    wide = np.empty(0, dtype=np.int64)
    for _ in range(WIDE_ROUNDS):
        top = of.where(F.col("apart") * F.col("n") > WIDE_PAIRS).select(F.col("g").alias("pivot"))
        sigs = groups.where(F.size("members") > SMALL).join(top, "pivot", "left_semi").select("sig").distinct().limit(MOST_WIDE - len(wide)).toArrow().column("sig").to_numpy()
        if not len(sigs):
            break
        wide = np.union1d(wide, sigs)
        passed = F.broadcast(spark.createDataFrame(pa.table({"sig": pa.array(sigs)})))
        past = scratch.settle(groups.join(passed, "sig", "left_semi").select("sig", "pivot", F.explode("members").alias("node")), "past")
        who = past.select("node").distinct()
        new = scratch.settle(signed(texts_of(who), np.sort(wide.view(np.uint64))).join(who, "node", "left_semi"), "signed")
        again = gathered(new)
        # What stays of a group that is passed over: its pivot, and the members that lack blocks.
        stay = past.join(new.where("short").select("node").distinct(), "node", "left_semi").select("sig", "pivot", F.array("node").alias("members"))
        groups = scratch.settle(groups.join(passed, "sig", "left_anti").union(stay).union(again), "groups")
        links.append(first_links(stars(again)))
        labels, star = labelled(links), stars(groups)
        m, of = mixed(star, labels)
    for few in (FEW, None):  # one link joins two components; all pairs of those that stay apart are looked at after that
        links.append(inside(m, of, few))
        labels = labelled(links)
        if few:
            m, of = mixed(star, labels)
    return labels


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of the smallest doc_id, then of the least hash of the text; of rows that repeat
    both, one. Rows that are linked with nothing stay, each: those without doc_id and those without words. Where rows share a
    doc_id but not a text, each is judged by its own component.
    """
    rows = _labelled(docs)
    first = rows.where("c is not null").groupBy("c", "doc_id", "of_text").agg(F.count("*").alias("n")).groupBy("c").agg(F.min(F.struct("doc_id", "of_text", "n")).alias("e"))
    first = settle(first.select("e.doc_id", "e.of_text", "e.n"), "first")
    alone = rows.where("c is null and doc_id is not null").select("doc_id", "of_text", F.lit(1).cast("long").alias("n")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of_text"))
    kept = own.join(first.union(alone), ["doc_id", "of_text"])
    ordered = F.xxhash64(*[F.col("own")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = kept.where("n > 1").groupBy("doc_id", "of_text").agg(F.min_by("own", ordered).alias("own"))
    out = kept.where("n = 1").select("own").union(one.select("own")).union(own.where("doc_id is null").select("own"))
    return out.select(*[F.col("own")[c].alias(c) for c in docs.columns])


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and near-copy components of all documents."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_jaccard": op9_jaccard}
SQL: dict[str, str] = {}
