"""Token ids in sorted-string-table shards, keyed by document identifier.

File format (integers little-endian; varint: 7 bits a byte, low first):

    block*   entries, then u32 crc32 of them. Entry: varint bytes shared with the key before (0 for a block's first),
             varint bytes not shared, varint count of ids, those key bytes, the ids (u16 or u32, see footer)
    index    for each block: varint key length, its first key, varint offset, varint length, varint ids before it
    bloom    bits; bit (h1 + i * h2) mod size for i < hashes, h1 and h2 the halves of a key's xxh3_128
    footer   u64 index offset, u64 bloom offset, u64 bloom bits, u64 entries, u64 ids, u32 hashes, u32 bytes an id,
             u32 crc32 of index and bloom, 8 bytes MAGIC

A lookup asks the Bloom filter, finds the block by binary search in the index, and reads that block alone. The index
(an entry for each 64 KB) and the filter (10 bits a key) are all that is held in memory.

Shards are ranges of keys, in order. Each task writes its shard under a name of its own and returns a line for the
manifest; only shards that the committed manifest names exist for readers, so tasks that ran twice or died leave
nothing that counts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_path
from .encoders import library_encoder, slices, worker_encoder

#: Bytes of text that a shard is made of, about.
SHARD_TEXT = 256_000_000
MAGIC, BLOCK, BITS_A_KEY, HASHES = b"MRTOKSS1", 1 << 16, 10, 7
FOOTER = struct.Struct("<5Q3I8s")
LINE = "shard string, part int, first_key binary, last_key binary, entries long, ids long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do; no identifier comes first."""
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = s = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << s
        if c < 128:
            return n, at
        s += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, (h & (2**64 - 1)) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Keys must come in ascending order (equal ones may repeat); memory: a block, the index and the keys' hashes."""

    def __init__(self, out, width: int = 2):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.index, self.places = bytearray(), None, [], []
        self.entries = self.ids = 0
        self.first: bytes | None = None
        self._begin: tuple[bytes, int] | None = None

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: packed in `width` bytes each."""
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        if self._begin is None:
            self._begin, shared = (key, self.ids), 0
            self.first = key if self.first is None else self.first
        else:
            shared, most = 0, min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        n = len(ids) // self.width
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:] + ids
        if key != self.last:
            self.places.append(key)
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + n
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self._begin is None:
            return
        data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.out.write(data)
        self.index.append((*self._begin, self.at, len(data)))
        self.at, self._begin = self.at + len(data), None
        self.block.clear()

    def close(self) -> int:
        """Write index, filter and footer; the file's size."""
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(before) for k, before, at, n in self.index)
        bits = max(64, len(self.places) * BITS_A_KEY)
        bloom = bytearray(-(-bits // 8))
        for key in self.places:
            for p in _bloom_places(key, bits, HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        body = index + bytes(bloom)
        self.out.write(body + FOOTER.pack(self.at, self.at + len(index), bits, self.entries, self.ids, HASHES, self.width, zlib.crc32(body), MAGIC))
        return self.at + len(body) + FOOTER.size


class Reader:
    """A shard by any seekable binary file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - FOOTER.size)
        self.index_at, bloom_at, self.bits, self.entries, self.ids, self.hashes, self.width, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(self.index_at)
        body = file.read(end - FOOTER.size - self.index_at)
        if zlib.crc32(body) != crc:
            raise ValueError("a damaged shard")
        index, self.bloom = body[: bloom_at - self.index_at], body[bloom_at - self.index_at :]
        self.blocks, at = [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            offset, at = _read_varint(index, at)
            size, at = _read_varint(index, at)
            before, at = _read_varint(index, at)
            self.blocks.append((key, offset, size, before))
        self.firsts = [b[0] for b in self.blocks]

    def _block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids before it in this shard, packed ids) of one block."""
        _, offset, size, before = self.blocks[k]
        self.file.seek(offset)
        data = self.file.read(size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a damaged block")
        at, key, end = 0, b"", len(data) - 4
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, before, data[at : at + n * self.width]
            at, before = at + n * self.width, before + n

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits, self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """The packed ids of every entry of that key, in order."""
        if not self.blocks or not self.may_have(key):
            return []
        k, out = max(0, bisect_right(self.firsts, key) - 1), []
        while k and self.firsts[k] == key:  # equal keys may have begun in a block before
            k -= 1
        while k < len(self.blocks) and self.firsts[k] <= key:
            out += [ids for found, _, ids in self._block(k) if found == key]
            k += 1
        return out


def _fs(path: str):
    from pyarrow import fs

    if path.startswith(("s3a://", "s3n://")):  # Spark's names for what pyarrow knows as s3
        path = "s3" + path[3:]
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write_shards(root: str, tokenizer: str, end_id: int, width: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, part = worker_encoder(library_encoder, tokenizer, False), TaskContext.get().partitionId()
        name, out, w = f"{part:06d}-{uuid.uuid4().hex}.sst", None, None
        for b in slices(batches, rows=1024):
            if out is None:
                files, folder = _fs(root)
                files.create_dir(folder, recursive=True)
                out = files.open_output_stream(f"{folder}/{name}")
                w = Writer(out, width)
            for d, ids in zip(b.column("doc_id").to_pylist(), encoder.texts(b.column("text")), strict=True):
                ids += end
                if width == 2:
                    wide = np.frombuffer(ids, "<u4")
                    if int(wide.max()) >= 1 << 16:
                        raise ValueError(f"id {int(wide.max())} does not go into 2 bytes: use width=4")
                    ids = wide.astype("<u2").tobytes()
                w.add(key_of(d), ids)
        if out is not None:
            size = w.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": name, "part": part, "first_key": w.first, "last_key": w.last, "entries": w.entries, "ids": w.ids, "bytes": size}], schema=pa.schema([("shard", pa.string()), ("part", pa.int32()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_table(docs: DataFrame, tokenizer_path: str, end_id: int, root: str | None = None, width: int = 2) -> tuple[str, DataFrame]:
    """(folder, manifest) of the shards that hold each row's ids and end_id, in ascending order of doc_id.

    docs needs doc_id and text; other columns are not looked at. A null or empty text is the end id alone; a null doc_id
    comes before all others; rows of one doc_id stand side by side, in the order of a hash of their texts. No rows: no
    shards. width: bytes of an id, 2 or 4; an id that does not go into 2 is an error. The manifest is a table in the folder, committed last.
    As many shards as SHARD_TEXT asks for, or as there are shuffle partitions, whichever is more.
    """
    spark = docs.sparkSession
    root = root or shared_path(spark, "sstable")
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_TEXT))
    rows = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return root, settle(rows.mapInArrow(_write_shards(f"{root}/data", tokenizer_path, end_id, width), LINE), "", f"{root}/manifest")


def _read_shards(root: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for row in b.to_pylist():
                files, folder = _fs(root)
                with files.open_input_file(f"{folder}/{row['shard']}") as f:
                    r, out = Reader(f), []
                    for key, before, ids in r.scan():
                        if r.width == 2:
                            ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                        out.append((id_of(key), row["base"] + before, len(ids) // 4, zlib.crc32(ids)))
                        if len(out) == 20_000:
                            yield _batch(out)
                            out = []
                    yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def scan_table(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each entry, read from the shards that the manifest names.

    The manifest's lines, one for each shard, are summed up on the driver to find how many ids come before each shard.
    """
    lines, before, shards = spark.read.schema(LINE).parquet(f"{root}/manifest").orderBy("part").collect(), 0, []
    for x in lines:
        shards.append((x.shard, before))
        before += x.ids
    listed = spark.createDataFrame(shards, "shard string, base long").repartition(max(1, len(shards)))
    return listed.mapInArrow(_read_shards(f"{root}/data"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, root: str, doc_id: int) -> list[list[int]]:
    """The ids of every entry of doc_id: by the manifest's key ranges, then a binary search in each shard of that range."""
    import numpy as np

    key, out = key_of(doc_id), []
    for x in spark.read.schema(LINE).parquet(f"{root}/manifest").where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("part").collect():
        files, folder = _fs(f"{root}/data")
        with files.open_input_file(f"{folder}/{x.shard}") as f:
            r = Reader(f)
            out += [np.frombuffer(ids, "<u2" if r.width == 2 else "<u4").tolist() for ids in r.get(key)]
    return out


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to shards and read back."""
    import public_tokenizers

    root, _ = write_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return scan_table(spark, root)


QUERIES = {"op6_sstable": op6_sstable}
SQL: dict[str, str] = {}
