"""What the training-data operators share: shared folders, tables cut from their lineage, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts: runs of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one machine may leave it unset, and
    has a temporary folder, the same for the life of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
        root = _own[0]
    return root.rstrip("/")


_runs: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one of the driver's own that is deleted when the driver ends."""
    root = shared_root(spark)
    if root not in _runs:
        _runs[root] = f"{root}/millrace/run-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_runs[root])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())

        @atexit.register
        def _delete() -> None:
            with suppress(Exception):  # the JVM may be gone
                files.delete(path, True)

    return f"{_runs[root]}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, its lineage cut."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run, in a folder of their own that is deleted when the block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, shared_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        forget(self.spark, self.root)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return settle(df, name, f"{self.root}/{self.n}-{name}")

    def settle_numbers(self, df: DataFrame, name: str) -> DataFrame:
        """settle(), for columns of numbers that recur: up to two million different ones of a file are written once."""
        self.n += 1
        return settle(df, name, f"{self.root}/{self.n}-{name}", **{"parquet.dictionary.page.size": str(16 << 20)})


@contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """Batches of about so many bytes go to Python workers, however many rows that is, in queries that run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def fold_case(text: Column) -> Column:
    """A-Z lowered, and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


#: Edges up to which one task finds components by itself (16 bytes an edge).
ONE_TASK_EDGES = 500_000


def _union_find(batches):
    import pyarrow as pa

    up: dict[int, int] = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(up.setdefault(u, u)), top(up.setdefault(v, v))
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK_EDGES, settle=settle) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Up to `one_task` edges, counted first, go to one task of an executor. More than that alternate large-star and
    small-star rounds (tables by `settle`), which keep connectivity and end in stars around the smallest node of each component, after a
    number of rounds that grows with the logarithm of the longest path. Each round is a table in the shared folder. A hub's
    neighbours are never gathered: each round takes only a minimum for each node, joined back to the edges by the node.
    """
    e, last = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), None
    e = settle(e, "edges")
    if e.count() <= one_task:
        return settle(e.repartition(1).mapInArrow(_union_find, "node long, component long"), "components")
    for _ in range(max_rounds):
        # Large star: each node links its larger neighbours to the smallest of its neighbours and itself.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        n, s = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, s) == last:
            break
        last = (n, s)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
