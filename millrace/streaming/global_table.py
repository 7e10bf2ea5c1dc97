"""A table that every task has, fed from another source's change log while streams are joined to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .compacted import CompactedLog
from .sinks import Folder

#: Bytes of a table that is broadcast, at most.
BROADCAST_BYTES = 64_000_000


class GlobalTable:
    """The store that the change log under `root` restores, as of its last committed batch, decoded to a table.

    Each version is written once, below `path`, and read by the batches that meet it; the one before stays for a batch that is under way. It
    is broadcast up to a size in bytes of its files, and joined by exchange beyond it.
    """

    def __init__(self, spark: SparkSession, root: str, path: str, decode: Callable[[DataFrame], DataFrame], most_bytes: int = BROADCAST_BYTES):
        self.spark, self.root, self.path, self.decode, self.most_bytes = spark, root, path, decode, most_bytes

    def _last(self) -> int:
        return max((int(p.rpartition("=")[2]) for p in sinks.committed(self.spark, self.root)), default=-1)

    def current(self) -> tuple[int, DataFrame]:
        """(version, table): that of the log's last committed batch, made if it is new."""
        version = self._last()
        folder = f"{self.path}/version={version}"
        if "_SUCCESS" not in Folder(self.spark, folder).names():
            self.decode(CompactedLog(self.spark, self.root).restored()).write.mode("overwrite").parquet(folder)
            held = sorted(int(n[8:]) for n in Folder(self.spark, self.path).names() if n.startswith("version="))
            for old in held[:-2]:
                Folder(self.spark, f"{self.path}/version={old}").delete()
        return version, self.spark.read.parquet(folder)

    def joined(self, rows: DataFrame, on: list[str], how: str = "left") -> DataFrame:
        """Rows of a batch with the table as it is now."""
        version, table = self.current()
        small = self._bytes(f"{self.path}/version={version}") <= self.most_bytes
        return rows.join(F.broadcast(table) if small else table, on, how)

    def _bytes(self, folder: str) -> int:
        at = Folder(self.spark, folder)
        return at.fs.getContentSummary(at.path).getLength()

    def follow(self, on: list[str], write: Callable[[DataFrame, int], None], how: str = "left") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch of a stream meets the table of its time."""

        def run(df: DataFrame, batch: int) -> None:
            write(self.joined(df, on, how), batch)

        return run
