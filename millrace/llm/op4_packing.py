"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

Each partition packs its own pieces by best fit (longest first, each into the bin whose room it leaves least), emits bins
that are full or nearly so, and passes on the underfull ones. Those bins, as items, meet the bins of other partitions in
a tree: each round merges the residue of a few partitions, packs it by best fit again, and emits what is nearly full; what
the root is left with is emitted as it is. Only small rows (bin, fill) travel between rounds. A group of residues is no larger than `group_items`:
a level that would need larger ones deals all its residue anew, so that each group gets a like mix of all
fills and complementary bins meet, and the tree ends when that leaves as many bins as before. Last, the pieces of the bins
that are underfull at the root are packed once more by themselves, which counts if it makes fewer sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle
from .encoders import library_encoder, slices, worker_encoder

CAPACITY = 2048
#: Rounds at most (a number of a bin has 7 bits for its round), and the share of its bins that a round of mixed groups has to save.
LEVELS, LEAST_SAVED = 120, 0.002
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, item long, bin long, shift long, fill long"
MOVES = "bin long, parent long, shift long, part int, fill long"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: for each item its bin and offset; for each bin its fill. Ties go to the earlier item.

    Bins wait in stacks by their free room, and the bits of one integer tell which stacks hold a bin, so that the
    tightest room that an item fits into is found in a step.
    """
    where, offset, fill = [0] * len(sizes), [0] * len(sizes), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        if not 0 < n <= capacity:
            raise ValueError(f"an item of {n} does not fit {capacity}")
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            stacks[room - n].append(b)
            rooms |= 1 << (room - n)
    return where, offset, fill


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: of a longer document, the first takes what is over."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _pack_texts(path: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), worker_encoder(library_encoder, path, True)
        rows: list[tuple] = []
        for b in slices(batches, rows=1024):
            for d, ids in zip(b.column("doc_id").to_pylist(), encoder.texts(b.column("text")), strict=True):
                ids += end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((d, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])))
        if not rows:
            return
        where, offset, fill = best_fit([r[3] for r in rows], capacity)
        base = part << 32
        columns = [*map(list, zip(*rows, strict=True)), [part] * len(rows), [base + i for i in range(len(rows))], [base + w for w in where], offset, [fill[w] for w in where]]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        t = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        yield from t.to_batches(max_chunksize=50_000)

    return run


def _pack_bins(level: int, capacity: int):
    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin")
        where, offset, fill = best_fit(pdf["fill"].tolist(), capacity)
        g = int(key[0])
        base = (level << 56) + (g << 32)
        return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "parent": [base + w for w in where], "shift": offset, "part": g, "fill": [fill[w] for w in where]})

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, fan_in: int = 8, slack: int = 4, group_items: int = 200_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document.

    docs needs doc_id and text; other columns are not looked at. A null or empty text is the end id alone. Repeated
    rows, and rows without doc_id, are packed as documents of their own. An empty table gives an empty result. Equal
    lengths are placed in the order of their rows. Sequences have no gap; all but the longest documents stay whole.
    slack: the free room up to which a bin is emitted before the root, the same in all rounds.
    """
    spark = docs.sparkSession
    pieces = settle(docs.select("doc_id", "text").mapInArrow(_pack_texts(tokenizer_path, end_id, capacity), PIECES), "pieces")
    bins = pieces.where(pieces.fill < capacity - slack).select("part", "bin", "fill").distinct()
    moves, level, before = None, 0, None
    while level < LEVELS:
        n, parts, last = bins.agg(F.count("*"), F.count_distinct("part"), F.max("part")).first()
        if parts < 2 or before is not None and n > (1 - LEAST_SAVED) * before:
            break
        level, groups, before = level + 1, -(-parts // fan_in), None
        g = F.floor(F.col("part") * groups / (F.lit(last) + 1)).cast("int")
        if bins.groupBy(g.alias("g")).count().agg(F.max("count")).first()[0] > group_items:
            # Too much for a group of this level: groups that are each a like mix of all fills, about half full so that none is above the
            # bound, until a round saves too little.
            groups, before = -(-2 * n // group_items), n
            g = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).cast("int")
        step = settle(bins.select(g.alias("g"), "bin", "fill").groupBy("g").applyInPandas(_pack_bins(level, capacity), MOVES), "moves")
        link = step.select("bin", "parent", "shift")
        if moves is None:
            moves = link
        else:
            up = link.select(F.col("bin").alias("parent"), F.col("parent").alias("top"), F.col("shift").alias("more"))
            moves = moves.join(up, "parent", "left").select("bin", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moves = settle(moves, "moves")
        bins = step.where(step.fill < capacity - slack).select("part", F.col("parent").alias("bin"), "fill").distinct()
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*keep, F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
    m = moves.select("bin", "parent", F.col("shift").alias("more"))
    placed = pieces.join(m, "bin", "left").select(*keep, "item", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("offset"))
    rest = placed.join(bins.select(F.col("bin").alias("sequence_id")), "sequence_id", "left_semi").select(F.col("item").alias("bin"), F.col("length").alias("fill"))
    rest_n = rest.count()
    groups = 1 if rest_n <= group_items else -(-2 * rest_n // group_items)
    again = rest.select(F.pmod(F.xxhash64("bin"), F.lit(groups)).cast("int").alias("g"), "bin", "fill").groupBy("g").applyInPandas(_pack_bins(level + 1, capacity), MOVES)
    again = settle(again, "again")
    if again.select("parent").distinct().count() >= bins.count():
        return placed.drop("item")
    again = again.select(F.col("bin").alias("item"), "parent", F.col("shift").alias("anew"))
    return placed.join(again, "item", "left").select(*keep, F.coalesce("parent", "sequence_id").alias("sequence_id"), F.coalesce("anew", "offset").alias("offset"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
SQL: dict[str, str] = {}
