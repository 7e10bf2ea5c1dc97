"""Sharding by size-tiered compaction, with DataFrame functions only.

A store is a folder: immutable Parquet shards, and a manifest for each version that lists the shards which make up the
table. Arrivals are appended as small shards. Compaction sorts the shards into tiers by size (each tier's shards up to
TIER times as large as the tier's least), takes each tier that has at least RUN shards below the target size, and
merges them into files of about the target size. The scan itself packs whole shards into tasks of the target size and each task
writes one file: no exchange, no row leaves its task, one job for each tier whatever the number of runs.

A commit writes the next version's manifest under a temporary name and renames it into place without overwriting, so
that a version appears whole or not at all and of two writers one fails with Conflict. The manifest holds the table's
schema: shards that lack a later column read as null there, and a merge writes all columns. A merge whose row count differs
from its shards' is not committed. Files of no version (of a task that ran twice, of a writer that died) do not count, and
vacuum() deletes them after a grace time.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, shared_path

TARGET, TIER, RUN, LEAST = 64 << 20, 4, 4, 1 << 20
ARRIVALS = 8
#: Seconds after which a file of no version is taken for left behind.
GRACE = 24 * 3600.0


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    born: int


def tier_of(size: int, least: int = LEAST, factor: int = TIER) -> int:
    return 0 if size < least else 1 + int(math.log(size / least, factor) + 1e-9)


def plan(shards: list[Shard], target: int = TARGET, run: int = RUN) -> list[list[Shard]]:
    """The shards of each tier that is due, smallest tier first. What has reached three quarters of the target rests."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < 0.75 * target:
            tiers.setdefault(tier_of(s.bytes), []).append(s)
    return [sorted(t, key=lambda s: s.path) for _, t in sorted(tiers.items()) if len(t) >= run]


class ShardStore:
    """A table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._jvm, self._conf = jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        p = self._path(f"{self.root}/manifest")
        return sorted(int(x.getPath().getName()[1:9]) for x in self._fs.listStatus(p) if x.getPath().getName().endswith(".json")) if self._fs.exists(p) else []

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, or of the latest; none before the first commit."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if not version:
            return []
        return [Shard(**s) for s in self._manifest(version)["shards"]]

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def schema(self, version: int | None = None) -> T.StructType | None:
        """The columns of a version, or of the latest: those of its first shards, then what later ones added."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        return T.StructType.fromJson(self._manifest(version)["schema"]) if version else None

    def _widened(self, rows: T.StructType) -> T.StructType:
        """The table's columns with those of new rows. A column that comes with another type is refused."""
        old = self.schema() or T.StructType()
        kinds = {f.name.lower(): f for f in old}
        for f in rows:
            if (had := kinds.get(f.name.lower())) is not None and had.dataType != f.dataType:
                raise ValueError(f"{f.name} is {had.dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
        return T.StructType([*old, *(T.StructField(f.name, f.dataType) for f in rows if f.name.lower() not in kinds)])

    def commit(self, shards: list[Shard], after: int, schema: T.StructType | None = None) -> int:
        """Make version after + 1, of these shards."""
        schema = schema or self.schema(after) or T.StructType()
        body = json.dumps({"version": after + 1, "rows": sum(s.rows for s in shards), "bytes": sum(s.bytes for s in shards), "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]})
        new, final = (self._path(f"{self.root}/manifest/{x}") for x in (f".{uuid.uuid4().hex}.tmp", f"v{after + 1:08d}.json"))
        stream = self._fs.create(new, False)
        try:
            stream.write(bytearray(body, "utf-8"))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(new, final, none)
        except Exception as e:
            self._fs.delete(new, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} exists") from e
            raise
        return after + 1

    def _written(self, folder: str, born: int) -> list[Shard]:
        """The files that a finished write left in a folder, with the row counts of their footers."""
        files = [x for x in self._fs.listStatus(self._path(folder)) if x.getPath().getName().endswith(".parquet")]
        if not files:
            return []
        by = {r[0]: r[1] for r in self.spark.read.parquet(folder).groupBy("_metadata.file_name").count().collect()}
        return [Shard(x.getPath().toString(), x.getLen(), by[x.getPath().getName()], born) for x in files if by.get(x.getPath().getName())]

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Append rows as small shards, in one commit. arrival: a column of small integers; each value is a batch with shards of
        its own, though one pass over rows writes them all. Returns the version."""
        version, folder = (self.versions() or [0])[-1], f"{self.root}/data/{uuid.uuid4().hex}"
        schema = self._widened(rows.schema)
        if arrival is None:
            rows.write.option("compression", "zstd").parquet(folder)
            made = self._written(folder, version + 1)
        else:
            own = next(n for n in (f"_batch{k}" for k in range(len(rows.columns) + 1)) if n not in map(str.lower, rows.columns))
            rows.withColumn(own, F.col(arrival)).write.option("compression", "zstd").partitionBy(own).parquet(folder)
            parts = sorted((x.getPath().getName() for x in self._fs.listStatus(self._path(folder)) if x.isDirectory()), key=lambda n: int(n.split("=")[1]))
            made = [s for name in parts for s in self._written(f"{folder}/{name}", version + 1)]
            if not made:
                return version
        return self.commit(self.shards(version) + made, version, schema)

    @contextmanager
    def _packing(self, target: int):
        """Scans put whole files together up to the target size."""
        new = {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        old = {k: self.spark.conf.get(k, None) for k in new}
        try:
            for k, v in new.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def compact(self, target: int = TARGET, run: int = RUN) -> int:
        """Merge what is due, tier by tier, until nothing is. A tier whose merge would make no fewer files is left as it is, and
        the next one follows. Returns the version."""
        settled: set[frozenset[str]] = set()
        while True:
            version = (self.versions() or [0])[-1]
            due = [t for t in plan(self.shards(version), target, run) if frozenset(s.path for s in t) not in settled]
            if not due:
                return version
            tier, schema = due[0], self.schema(version)
            gone, folder = frozenset(s.path for s in tier), f"{self.root}/data/{uuid.uuid4().hex}"
            with self._packing(target):
                self.spark.read.schema(schema).parquet(*gone).write.option("compression", "zstd").parquet(folder)
            made = self._written(folder, version + 1)
            if sum(s.rows for s in made) != sum(s.rows for s in tier):
                raise RuntimeError("a merge lost or made rows")
            if len(made) >= len(tier):
                settled.add(gone)
                forget(self.spark, folder)
                continue
            self.commit([s for s in self.shards(version) if s.path not in gone] + made, version)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version; None before the first row."""
        live = self.shards(version)
        return self.spark.read.schema(self.schema(version)).parquet(*[s.path for s in live]) if live else None

    def _files(self) -> list[tuple[str, float]]:
        """(path, seconds since the epoch) of every data file."""
        p, out = self._path(f"{self.root}/data"), []
        found = self._fs.listFiles(p, True) if self._fs.exists(p) else None
        while found is not None and found.hasNext():
            x = found.next()
            out.append((x.getPath().toString(), x.getModificationTime() / 1000))
        return out

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Delete the shards that none of the latest `keep` versions names, and files of no version that are older than `grace`
        seconds; how many shards went. Readers of older versions fail."""
        have = self.versions()
        named = {s.path for v in have[-keep:] for s in self.shards(v)}
        old = {s.path for v in have[:-keep] for s in self.shards(v)} - named
        gone = 0
        for p, at in self._files():
            if p in old or p not in named and at < time.time() - grace:
                forget(self.spark, p)
                gone += p.endswith(".parquet")
        return gone


def shard_documents(docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, target: int = TARGET) -> ShardStore:
    """A store of the rows of docs, which came as `arrivals` batches (by doc_id), compacted.

    Needs doc_id; every column is stored; a column named `arrival` is replaced by the batch. A null doc_id comes with the first
    batch. Nulls, long texts and repeated rows are kept as they are. An empty table makes a store without versions.
    """
    store = ShardStore(docs.sparkSession, root or shared_path(docs.sparkSession, "shards"))
    store.append(docs.withColumn("arrival", F.coalesce(F.pmod("doc_id", F.lit(arrivals)), F.lit(0)).cast("int")), "arrival")
    store.compact(target)
    store.vacuum()
    return store


def op1_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, read back from the committed version of a store: identity, batch, and a digest of each text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = shard_documents(docs).read()
    if rows is None:
        rows = docs.limit(0).withColumn("arrival", F.lit(0))
    return rows.select("doc_id", "arrival", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {"op1_compaction": op1_compaction}
SQL = {"op1_compaction": f"SELECT doc_id, CAST(coalesce(doc_id % {ARRIVALS}, 0) AS INTEGER) AS arrival, lang, source, n_chars, md5(text) AS text_md5 FROM documents"}
