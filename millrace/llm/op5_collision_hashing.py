"""Approximate nearest neighbours by collision counting over query-aware projections.

Rows go to the nearest of PIVOTS pivots and lie in blocks in the order of their pivots, so that a block's rows are neighbours. A block's index
is PROJECTIONS random lines, and along each the block's vectors in sorted order. A query puts a window of half width WIDTH / 2 *
radius around its own place on each line; all windows widen together as the radius grows (virtual rehashing: nothing is hashed
anew), and each vector that a window newly reaches counts a collision. A vector with collisions on a share THRESHOLD of the lines is
verified by its true distance. There is no limit on candidates.

A query ends where the radius is STOP times the distance of its K-th nearest so far: of those found in this task, or of a sample of
at most SAMPLE rows, whichever is nearer (the sample gives pivots and these bounds, which hold for all rows; every row is indexed).
A vector as near as the K-th then has collisions on 0.76 of the lines in the mean, one and a half standard deviations above the threshold. A block
that too few of a query's widest windows touch, or whose ball lies beyond the bound, is not opened for it.

Queries come in chunks of QUERY_BYTES (a bound on what is broadcast), each against all rows, in blocks. What comes back from a task are K rows
for each query, of which a window keeps the nearest K.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, settle

PROJECTIONS, WIDTH, THRESHOLD, GROWTH, STOP = 128, 2.72, 0.70, 1.2, 0.87
BLOCK_ROWS, QUERY_BYTES, SAMPLE, PIVOTS, SEED = 16_384, 64_000_000, 4_096, 256, 20_240
FOUND = "query_id long, vec_id long, score double"


def lines_of(length: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, PROJECTIONS))


class Index:
    """Sorted projections of one block's vectors, all of one length. The lines' sorted arrays lie one after another, `gap` apart."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x, self.verified = ids, vectors, 0
        p = (vectors @ lines_of(vectors.shape[1])).T
        order = np.argsort(p, axis=1, kind="stable")
        places = np.take_along_axis(p, order, axis=1)
        self.low, self.high = places[:, 0].copy(), places[:, -1].copy()
        self.order = order.ravel()
        gap = 4 * max(float(np.abs(places).max()), 1e-300)
        self.plain = not np.isfinite(gap * PROJECTIONS)  # beyond the range of floats: no windows, every vector is verified
        self.at, self.edge = np.arange(PROJECTIONS) * gap, gap / 2
        self.places = (places + self.at[:, None]).ravel()
        self.least = 1e-9 * gap  # what rounding may move a place by
        spread = float(np.median(places[:, 3 * len(ids) // 4] - places[:, len(ids) // 4]))
        self.centre = vectors.mean(axis=0)
        self.reach = float(np.sqrt(((vectors - self.centre) ** 2).sum(axis=1)).max())
        self.start = max(spread, 1e-12) / 32

    def touched(self, x: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which queries (vectors, their places, bounds on the distance of the k-th) may find something here: the ball around the block's
        centre comes as near as the bound, and windows at the last radius touch enough lines."""
        half = (WIDTH / 2 * STOP * bounds + self.least)[:, None]
        enough = ((at + half >= self.low) & (at - half <= self.high)).sum(1) >= THRESHOLD * PROJECTIONS
        away = _distances(x, self.centre[None])[:, 0] * (1 - 1e-6) - self.reach * (1 + 1e-6)
        return enough & ~(away > bounds) | self.plain | ~np.isfinite(at).all(1)

    def nearest(self, q: np.ndarray, at: np.ndarray, own: int, k: int, found: tuple[np.ndarray, np.ndarray], bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of those found before and in this block, ties to the smaller id, without id own."""
        n = len(self.ids)
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        count, open_, plain = np.zeros(n, dtype=np.int64), self.ids != own, self.plain or not np.isfinite(at).all()
        found_d, found_i = found

        def end() -> float:
            return STOP * min(bound, found_d[k - 1] if len(found_d) >= k else np.inf)

        lo = hi = np.zeros(PROJECTIONS, dtype=np.int64) if plain else np.searchsorted(self.places, np.clip(at, -self.edge, self.edge) + self.at)
        radius = min(self.start, end())
        while True:
            half = WIDTH / 2 * radius + self.least
            if plain:
                half, count[:] = np.inf, need
            a = np.searchsorted(self.places, np.clip(at - half, -self.edge, self.edge) + self.at, "left")
            b = np.searchsorted(self.places, np.clip(at + half, -self.edge, self.edge) + self.at, "right")
            new = [self.order[i:j] for i, j in zip(a.tolist(), lo.tolist(), strict=True) if i < j]
            new += [self.order[i:j] for i, j in zip(hi.tolist(), b.tolist(), strict=True) if i < j]
            lo, hi = np.minimum(a, lo), np.maximum(b, hi)
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
            hit = np.flatnonzero(open_ & (count >= need))
            if len(hit):
                open_[hit] = False
                self.verified += len(hit)
                d = np.sqrt(((self.x[hit] - q) ** 2).sum(axis=1))
                found_d, found_i = np.concatenate([found_d, d]), np.concatenate([found_i, self.ids[hit]])
                keep = np.lexsort((found_i, found_d))
                _, once = np.unique(found_i[keep], return_index=True)  # an id counts by its nearest row
                keep = keep[np.sort(once)[:k]]
                found_d, found_i = found_d[keep], found_i[keep]
            if plain or radius >= end() or int((hi - lo).sum()) == n * PROJECTIONS:
                return found_d, found_i
            radius = min(radius * GROWTH, end())


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by length, of the rows whose vectors take part."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        if i is None or not v or None in v:
            continue
        x = np.array(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            ids, xs = by.setdefault(len(v), ([], []))
            ids.append(i)
            xs.append(x)
    for ids, xs in by.values():
        yield np.array(ids, dtype=np.int64), np.array(xs)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x to each row of y, good to rounding of a product: for cells, never for scores."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0))


def _cells(shared):
    """Each row with the number of its nearest pivot; rows whose vectors take no part go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in _vectors(b):
                pivots = shared.value.get(x.shape[1])
                cell = np.zeros(len(ids), dtype=np.int64) if pivots is None else _distances(x, pivots[1][:PIVOTS]).argmin(1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), flat, pa.array(x.shape[1] * PIVOTS + cell)], names=["vec_id", "embedding", "cell"])

    return run


def _search(shared, k: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, sample = shared.value  # each {length: (ids, vectors)}
        waiting: dict[int, list] = {}
        state: dict[int, tuple] = {}

        def begin(length: int) -> tuple:
            """Places of the queries, their bounds from the sample, and nothing found."""
            ids, x = queries[length]
            bounds = np.full(len(ids), np.inf)
            if length in sample:
                other, y = sample[length]
                for i, q in enumerate(x):
                    d = np.sqrt(((y[other != ids[i]] - q) ** 2).sum(axis=1))
                    if len(d) >= k:
                        bounds[i] = np.partition(d, k - 1)[k - 1]
            return x @ lines_of(length), bounds, [(np.empty(0), np.empty(0, dtype=np.int64))] * len(ids)

        def block(length: int) -> None:
            parts = waiting.pop(length)
            index = Index(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            if length not in state:
                state[length] = begin(length)
            (ids, x), (at, bounds, found) = queries[length], state[length]
            for i in np.flatnonzero(index.touched(x, at, bounds)).tolist():
                found[i] = d, _ = index.nearest(x[i], at[i], int(ids[i]), k, found[i], bounds[i])
                if len(d) >= k:
                    bounds[i] = min(bounds[i], d[k - 1])

        for b in batches:
            for ids, x in _vectors(b):
                if (length := x.shape[1]) in queries:
                    waiting.setdefault(length, []).append((ids, x))
                    if sum(len(p[0]) for p in waiting[length]) >= block_rows:
                        block(length)
        for length in list(waiting):
            block(length)
        for length, (_, _, found) in state.items():
            for (d, i), q in zip(found, queries[length][0].tolist(), strict=True):
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(d), pa.int64()), pa.array(i), pa.array(d)], names=["query_id", "vec_id", "score"])

    return run


def _by_length(df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    parts: dict[int, list] = {}
    for b in df.toArrow().to_batches():
        for ids, x in _vectors(b):
            parts.setdefault(x.shape[1], []).append((ids, x))
    return {n: (np.concatenate([p[0] for p in v]), np.concatenate([p[1] for p in v])) for n, v in parts.items()}


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest among rows of other ids, by Euclidean distance.

    Both need vec_id and embedding; other columns are not looked at. Rows whose vec_id is null or whose vector is null,
    empty, zero, or holds null or non-finite components take no part, and vectors meet only those of their own length. A
    row that repeats counts once; one id with several vectors counts once, by its nearest. Ties go to the smaller id. A
    query of fewer than k candidates gets them all, one of none gets no row; so do empty tables.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    rows = rows.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").where("vec_id is not null")
    queries = queries.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").where("vec_id is not null")
    sample = {}
    for n, (ids, x) in _by_length(rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id")).limit(SAMPLE)).items():
        _, once = np.unique(ids, return_index=True)  # an id counts once, also for a bound
        once.sort()
        sample[n] = ids[once], x[once]
    tasks = max(sc.defaultParallelism, -(-rows.count() // block_rows))
    placed = rows.mapInArrow(_cells(sc.broadcast(sample)), "vec_id long, embedding array<double>, cell long")
    placed = placed.repartitionByRange(tasks, "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")
    size = queries.agg(F.coalesce(F.sum(8 * F.size("embedding") + 8 * PROJECTIONS), F.lit(0))).first()[0]
    chunks = max(1, -(-size // query_bytes))
    found = []
    with Scratch(spark, "neighbours") as scratch:
        if chunks > 1:
            placed = scratch.settle(placed, "blocks")
        for c in range(chunks):
            by = _by_length(queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c))
            found.append(placed.mapInArrow(_search(sc.broadcast((by, sample)), k, block_rows), FOUND))
        best = reduce(DataFrame.union, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        best = settle(best, "neighbours") if chunks > 1 else best
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_collision_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op5_collision_hashing": op5_collision_hashing}
SQL: dict[str, str] = {}
