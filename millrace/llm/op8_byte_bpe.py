"""Byte-level BPE by a segment tree over byte positions.

Each leaf holds the key of the pair that starts at its byte: the pair's rank, then the position, so that the root is the
lowest rank and, among equal ranks, the leftmost pair. A merge joins the two neighbours found at the root and sets
three leaves anew (the merged one, the one it absorbs, the live neighbour to the left), each with an update of the nodes
above it. Pieces of up to 64 bytes go through the tree many at a time, one numpy row each; longer ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .encoders import ChunkMemo, slices, worker_encoder

NONE = np.int64(2**62)
WIDEST = 64
MEMO = 600_000
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class SegmentTreeBPE:
    """Encoding and decoding by a rank file: a line for each token, its bytes in base64 and its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {r: b for b, r in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._keys = np.array(sorted(pairs), dtype=np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], dtype=np.int64)
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> SegmentTreeBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the two do not join."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of 1 to WIDEST bytes."""
        n, w = len(pieces), max(2, 1 << (max(map(len, pieces)) - 1).bit_length())
        shift = w.bit_length() - 1
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), np.uint8).reshape(n, w)
        place = np.arange(w)
        live = place < size[:, None]
        # One column of spare places to the right stands for "no neighbour"; -1 reaches it too.
        token = np.full((n, w + 1), -1, dtype=np.int64)
        token[:, :w] = np.where(live, self._bytes[raw], -1)
        after = np.tile(np.arange(1, w + 2), (n, 1))
        after[np.arange(n), size - 1] = w
        before = np.tile(np.arange(-1, w), (n, 1))
        tree = np.full((n, 2 * w), NONE, dtype=np.int64)
        both = live[:, :-1] & live[:, 1:]
        rank = self._rank(np.where(both, token[:, : w - 1], 0), np.where(both, token[:, 1:w], 0))
        tree[:, w : 2 * w - 1] = np.where(both & (rank < NONE), rank << shift | place[:-1], NONE)
        level = w >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1

        def put(rows, at, value):
            x = w + at
            tree[rows, x] = value
            for _ in range(shift):
                x >>= 1
                tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])

        def key(rows, left, right):
            a, b = token[rows, left], token[rows, right]
            ok = (a >= 0) & (b >= 0)
            r = self._rank(np.where(ok, a, 0), np.where(ok, b, 0))
            return np.where(ok & (r < NONE), r << shift | left, NONE)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & (w - 1)
            j = after[rows, i]
            k = after[rows, j]
            token[rows, i], token[rows, j] = top >> shift, -1
            after[rows, i], before[rows, k] = k, i
            put(rows, j, NONE)
            put(rows, i, key(rows, i, k))
            p = before[rows, i]
            has = p >= 0
            put(rows[has], p[has], key(rows[has], p[has], i[has]))
            rows = rows[tree[rows, 1] < NONE]
        ids, keep = token[:, :w], token[:, :w] >= 0
        flat, ends = ids[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        n = len(piece)
        w = max(2, 1 << (n - 1).bit_length())
        pairs, shift, none = self.pairs, w.bit_length() - 1, int(NONE)
        token = [int(self._bytes[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * w)

        def key(a, b):
            r = pairs.get(token[a] << 32 | token[b])
            return none if r is None else r << shift | a

        def put(at, value):
            x = w + at
            tree[x] = value
            x >>= 1
            while x:
                tree[x] = min(tree[2 * x], tree[2 * x + 1])
                x >>= 1

        for a in range(n - 1):
            tree[w + a] = key(a, a + 1)
        for x in range(w - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        while (top := tree[1]) < none:
            i = top & (w - 1)
            j = after[i]
            k = after[j]
            token[i], token[j] = top >> shift, -1
            after[i] = k
            put(j, none)
            if k < n:
                before[k] = i
                put(i, key(i, k))
            else:
                put(i, none)
            if (p := before[i]) >= 0:
                put(p, key(p, i))
        return [t for t in token if t >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Fill in `pieces` for matches of the pattern not met before."""
        if len(self.pieces) + len(pieces) > MEMO:
            self.pieces.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if (r := self.ranks.get(raw)) is not None:
                self.pieces[p] = array("I", (r,)).tobytes()
            elif len(raw) > WIDEST:
                self.pieces[p] = array("I", self.merge_one(raw)).tobytes()
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for group in by_width.values():
            for k in range(0, len(group), 4096):
                part = group[k : k + 4096]
                for (p, _), ids in zip(part, self.merge_many([raw for _, raw in part]), strict=True):
                    self.pieces[p] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        found = [self.find(t) for t in texts]
        every = set().union(*found)
        if fresh := every - self.pieces.keys():
            if len(self.pieces) + len(fresh) > MEMO:
                self.pieces.clear()
                fresh = every
            self.learn(fresh)
        return [b"".join(map(self.pieces.__getitem__, f)) for f in found]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def bpe_encoder(path: str, pattern: str) -> ChunkMemo:
    """Whole texts, chunk by chunk; .bpe decodes."""
    bpe = SegmentTreeBPE.load(path, pattern)
    memo = ChunkMemo(bpe.encode, True)
    memo.bpe = bpe
    return memo


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(bpe_encoder, path, pattern)
        for b in slices(batches):
            ids = encoder.texts([t or "" for t in b.column("text").to_pylist()])
            back = [hashlib.sha256(encoder.bpe.decode(x)).hexdigest() for x in ids]
            columns = [b.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])

    return run


def _both_ways(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(bpe_encoder, path, pattern)
        for b in slices(batches):
            ids = encoder.texts([t or "" for t in b.column("text").to_pylist()])
            columns = [b.column("doc_id"), pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([encoder.bpe.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<long>, decoded binary) of each row of docs; one pass, no exchange.

    docs needs doc_id and text; other columns are not looked at. A null or empty text has no ids. Repeated rows give
    repeated results. A text's length is bounded by memory for the text and its ids alone.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_both_ways(path, pattern), "doc_id long, ids array<long>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode_documents, with digests of ids and decoded bytes in their place, taken where they are made."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_digests(path, pattern), OUT)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the ranks of a public vocabulary for many languages."""
    import public_tokenizers as P

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
SQL: dict[str, str] = {}
