"""Work outside the store: the jobs that handlers of a batch scheduled, and how their results come back as records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import header
from ..operators import asynchronous
from ..sources import envelope
from .processor import DONE, ERROR, OF_KEY, OF_TOPIC

#: From a job's key and value to its result; what it raises is the job's error.
Work = Callable[[bytes, bytes], bytes | None]


@dataclass(frozen=True)
class Stage:
    work: Work
    config: asynchronous.SchedulerConfig


def folder(root: str) -> str:
    return f"{root}/done"


def _worked(work: Work) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(key: bytes, value: bytes | None) -> tuple[bytes | None, str | None]:
        try:
            return work(bytes(key), bytes(value or b"")), None
        except Exception as e:  # it goes to the finalizer
            return None, str(e) or type(e).__name__

    def run(p: pd.DataFrame) -> pd.DataFrame:
        done = [one(k, v) for k, v in zip(p["key"], p["value"], strict=True)]
        return p.assign(result=pd.Series([d[0] for d in done], dtype=object, index=p.index), error=pd.Series([d[1] for d in done], dtype=object, index=p.index))[["source", "partition", "offset", "key", "home", "result", "error"]]

    return run


WORKED = "source string, partition int, offset long, key binary, home binary, result binary, error string"


def run(written: DataFrame, stages: dict[str, Stage], root: str, batch: int, by: str) -> bool:
    """Do the jobs among a batch's outputs and leave their results for the stream to take; whether there were any. The jobs of a key
    run in the order of their records, one after the other. A batch that runs again replaces its results, of which none has been taken."""
    jobs = written.where("out = 'job'")
    names = [r[0] for r in jobs.select("topic").distinct().collect()]  # as many as there are stages
    if unknown := set(names) - set(stages):
        raise LookupError(f"no stage {min(unknown)}")
    if not names:
        return False
    done = []
    for name in sorted(names):
        own = jobs.where(F.col("topic") == name).select("source", "partition", "offset", "key", "value", "home", "seq")
        work, config = _worked(stages[name].work), stages[name].config
        # A frame for each key costs more than most work, and is needed only where keys run side by side.
        worked = asynchronous.in_turn(own, "key", ["partition", "seq"], work, WORKED) if config.concurrency == 1 else asynchronous.keyed(own, "key", ["partition", "seq"], work, WORKED, config)
        done.append(worked.withColumn("stage", F.lit(name)))
    rows = reduce(DataFrame.unionByName, done)
    said = F.array(header(OF_TOPIC, F.col("source")), F.struct(F.lit(OF_KEY).alias("key"), F.col("key").alias("value")))
    heads = F.when(F.col("error").isNull(), said).otherwise(F.array_append(said, header(ERROR, F.col("error")))).cast(envelope.HEADERS)
    back = rows.select(
        F.lit(DONE).alias("topic"), "partition", "offset", F.lit(0).alias("leader_epoch"), F.current_timestamp().alias("timestamp"),
        (F.col("home") if by == "key" else F.col("key")).alias("key"), F.col("result").alias("value"), heads.alias("headers"), F.col("stage").alias("record_type"),
    )
    back.write.mode("overwrite").parquet(f"{folder(root)}/batch={batch}")
    return True


def returned(spark: SparkSession, root: str) -> DataFrame:
    """The stream of what comes back."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(root))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema(envelope.SCHEMA).option("recursiveFileLookup", "true").parquet(folder(root))
