"""A change log on disk that is compacted as it grows: a sorted snapshot of the last entry of each key, and the batches since."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import latest
from . import sinks
from .sinks import Folder

#: Of all entries, the share that batches since the last snapshot have when it pays to merge them in.
DIRTY = 0.5
#: Milliseconds that a deletion stays in snapshots, for readers that are behind.
RETENTION_MS = 24 * 3600 * 1000
#: Rows of a file of a snapshot.
ROWS = 5_000_000
ENTRY = "of int, home binary, key binary, value binary, record_type string, partition int, seq bigint, deleted_ms bigint"


@dataclass(frozen=True)
class Manifest:
    """Snapshot `version` has the last entries of all batches up to `upto`; `rows` of them, at `path`."""

    version: int = 0
    upto: int = -1
    rows: int = 0
    path: str | None = None


class CompactedLog:
    """The change log under a source's root. A merge reads the snapshot and the committed batches since, writes a new snapshot beside them, and
    commits it by a manifest whose name may not exist yet; only then do merged entries of batches go, and the snapshot before the last. A reader that
    has a manifest finds its files until the merge after the next."""

    def __init__(self, spark: SparkSession, root: str, checkpoint: str | None = None, dirty: float = DIRTY, retention_ms: int = RETENTION_MS):
        self.spark, self.root, self.checkpoint, self.dirty, self.retention_ms = spark, root, checkpoint, dirty, retention_ms

    @property
    def _folder(self) -> str:
        return f"{self.root}/compacted"

    def _paths(self):
        to = self.spark._jvm.org.apache.hadoop.fs.Path
        return to, to(self._folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The last one; at first, that of no snapshot."""
        versions = [int(n[9:-5]) for n in Folder(self.spark, self._folder).names() if re.fullmatch(r"manifest-\d+\.json", n)]
        if not versions:
            return Manifest()
        text = self.spark.read.text(f"{self._folder}/manifest-{max(versions)}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, m: Manifest) -> None:
        """A manifest by rename, which fails where another merge has made one of the same number."""
        to, files = self._paths()
        temporary = to(f"{self._folder}/.{uuid.uuid4().hex}")
        out = files.create(temporary, True)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(temporary, to(f"{self._folder}/manifest-{m.version}.json"), none)

    def _batches(self, after: int) -> list[tuple[int, str]]:
        """Committed batches after one that have entries."""
        found = [(int(p.rpartition("=")[2]), p) for p in sinks.committed(self.spark, self.root, self.checkpoint)]
        return [(b, f"{p}/out=changelog") for b, p in found if b > after and "out=changelog" in Folder(self.spark, p).names()]

    def _entries(self, m: Manifest, batches: list[tuple[int, str]]) -> DataFrame:
        parts = []
        if m.path is not None:
            parts.append(self.spark.read.schema(ENTRY).parquet(m.path))
        if batches:
            tail = self.spark.read.schema(sinks.OUTPUT).parquet(*[p for _, p in batches])
            of = F.when(F.col("home").isNull(), F.col("partition")).alias("of")
            parts.append(tail.select(of, "home", "key", "value", "record_type", "partition", "seq", F.lit(None).cast("bigint").alias("deleted_ms")))
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def entries(self) -> DataFrame:
        """(of, home, key, value, record_type, partition, seq, deleted_ms): snapshot and tail; in the snapshot one entry of each key."""
        m = self.manifest()
        return self._entries(m, self._batches(m.upto))

    def restored(self) -> DataFrame:
        """(partition, key, value): the store."""
        last = latest(self.entries(), ["of", "home", "key"], "seq", ["partition", "value"])
        return last.where("value is not null").select("partition", "key", "value")

    def compact(self, now_ms: int | None = None, force: bool = False) -> bool:
        """Merge, if the tail has more than the dirty share of all entries; whether it did. Deletions older than the retention go."""
        now, m = int(time.time() * 1000) if now_ms is None else now_ms, self.manifest()
        batches = self._batches(m.upto)
        if not batches:
            return False
        tail = self._entries(Manifest(), batches).count()  # of Parquet's footers
        if not force and tail <= self.dirty * (tail + m.rows):
            return False
        last = latest(self._entries(m, batches), ["of", "home", "key"], "seq", ["value", "record_type", "partition", "seq", "deleted_ms"])
        last = last.withColumn("deleted_ms", F.when(F.col("value").isNull(), F.coalesce("deleted_ms", F.lit(now))))
        last = last.where(F.col("value").isNotNull() | (F.col("deleted_ms") > now - self.retention_ms))
        path = f"{self._folder}/snapshot-{m.version + 1}-{uuid.uuid4().hex}"
        order = ["of", "home", "key"]
        last.select(*[c.split()[0] for c in ENTRY.split(", ")]).repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", ROWS).parquet(path)
        self._commit(Manifest(m.version + 1, batches[-1][0], self.spark.read.schema(ENTRY).parquet(path).count(), path))
        for _, p in batches:
            Folder(self.spark, p).delete()
        for n in Folder(self.spark, self._folder).names():
            if (k := re.match(r"snapshot-(\d+)-", n)) and int(k[1]) < m.version:
                Folder(self.spark, f"{self._folder}/{n}").delete()
        return True
