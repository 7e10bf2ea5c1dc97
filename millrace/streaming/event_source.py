"""A stateful event source on Structured Streaming."""

from __future__ import annotations

import logging
import signal
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import commitlog
from ..operators.asynchronous import SchedulerConfig
from ..sources import envelope
from ..sources.config import ErrorResponse, SourceConfig
from . import jobs, sinks
from .metrics import Metrics
from .ordered import BLOCK
from .processor import KEY, OUTPUT, Finalizer, Handler, HandlerTable, Interjection, PartitionProcessor, as_records, shard

log = logging.getLogger(__name__)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PartitionNotAssigned(LookupError):
    """A question to a partition that the source does not have, or has no state of yet."""


class EventSource:
    """Handlers by record type over an envelope stream, with a store for each partition, or for each key.

    State by partition lets a handler see every key of its partition, as one thread would; state by key spreads a
    partition's keys over tasks, in shards of keys. Exactly once: the checkpoint holds offsets and state of a batch, the sink takes
    each batch once. The shuffle partitions of the first run hold for the life of a checkpoint.
    """

    def __init__(self, spark: SparkSession, config: SourceConfig, rows: DataFrame, root: str, by: str = "partition"):
        if by not in ("partition", "key"):
            raise ValueError("by is partition or key")
        self.spark, self.config, self.rows, self.root, self.by = spark, config, rows, root, by
        self.table, self.timers, self.query, self.error, self.initial, self._how = HandlerTable(), [], None, None, None, (False, None)
        self.stages: dict[str, jobs.Stage] = {}
        self.block: int | None = None
        self._jobs = False
        self.table.fail_on_decode = config.on_decode_error(ValueError("a record did not decode")) is not ErrorResponse.CONTINUE
        self.metrics = Metrics(config.topic, config.group_id)

    def register(self, kind: str, decode: Callable[[bytes | None], Any], handler: Handler) -> EventSource:
        """The first handler of a type counts."""
        self.table.chain.append((kind, decode, handler))
        return self

    def register_default(self, handler: Handler) -> EventSource:
        self.table.default = handler
        return self

    def schedule_interjection(self, run: Interjection, every_ms: int, jitter_ms: int = 0) -> EventSource:
        """run on each partition's store, again and again; timers start with a partition's first record."""
        self.timers.append((every_ms, jitter_ms, run))
        return self

    def with_ordered_state(self, block: int = BLOCK) -> EventSource:
        """Give handlers ctx.ordered, a map in key order, and ctx.queue, a queue with two ends that lives in it: one or the other is used. They
        are state of each group beside the store, in blocks of so many keys, and part of the checkpoint, not of the change log."""
        self.block = block
        return self

    def ordered_state(self) -> DataFrame:
        """(partition or key, item_key, value): all ordered state as of the last committed batch."""
        raw = self.spark.read.format("statestore").option("stateVarName", "blocks").load(self.checkpoint)
        return raw.select(self._of(), F.explode(F.arrays_zip("user_map_value.keys", "user_map_value.vals")).alias("e")).select("*", F.col("e.keys").alias("item_key"), F.col("e.vals").alias("value")).drop("e")

    def register_async(self, stage: str, work: jobs.Work, finalizer: Finalizer | None = None, config: SchedulerConfig = SchedulerConfig()) -> EventSource:
        """Work outside the store, in order for each key and parallel across keys, for records that a handler leaves with
        `return ctx.schedule(stage, key, value)`. Its result, or the error that it raised, goes to the finalizer, which has the store
        again and may schedule a further stage; without one the record is done. Until then the record is held, and the commit log does not pass it. What
        is scheduled in one batch comes back in the next. Work may run again after a failure; its result counts once."""
        self.stages[stage] = jobs.Stage(work, config)
        self.table.finalizers[stage] = finalizer
        return self

    def bootstrap(self, log: DataFrame, marks: DataFrame | None = None) -> EventSource:
        """Start a new group from the store that a change log restores, and go on at marks (topic, partition, next_offset; without topic
        those of the source's own). It counts in the first run of a checkpoint; later ones have state of their own. The log is of a
        source whose groups are of the same kind. Where they are keys, rows below their partition's mark are filtered before they are grouped."""
        if self.by == "key" and marks is not None:
            own = marks if "topic" in marks.columns else marks.withColumn("topic", F.lit(self.config.topic))
            self.rows = commitlog.fresh(self.rows, own.select("topic", F.col("partition").cast("int").alias("partition"), "next_offset"), ["topic", "partition"], "offset")
            marks = None
        self.initial = sinks.bootstrap(log, marks, self.config.topic)
        return self

    def bootstrap_from(self, root: str) -> EventSource:
        """bootstrap() from the change log and the commit log that another source, of as many partitions, left under root."""
        self.config.resolved({self.config.changelog: sinks.partitions_of(self.spark, root) or self.config.num_partitions})
        return self.bootstrap(sinks.changelog(self.spark, root), sinks.commits(self.spark, root))

    @property
    def checkpoint(self) -> str:
        return self.config.checkpoint(f"{self.root}/checkpoints")

    def _hook(self, name: str) -> None:
        if (f := getattr(self.config, name)) is not None:
            f(self)

    def start(self, available_now: bool = False, then: Callable[[DataFrame, int], None] | None = None) -> EventSource:
        """Start without waiting. available_now: do what is there, then end. A change log of another number of partitions than the source's is
        an error."""
        self.config.resolved({self.config.changelog: sinks.partitions_of(self.spark, self.root, self.config.num_partitions)})
        self.spark.streams.addListener(self.metrics)
        self._hook("on_assigned")
        self._run(available_now, then)
        self._hook("on_activated")
        return self

    def _run(self, available_now: bool, then: Callable[[DataFrame, int], None] | None) -> None:
        self._how = available_now, then
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        rows, initial, group = self.rows, None, "partition" if self.by == "partition" else "shard"
        if self.stages:
            rows = rows.select(*envelope.COLUMNS).unionByName(jobs.returned(self.spark, self.root))
        if self.initial is not None:
            # As strings, for numbers with nulls come as floats.
            initial = self.initial.withColumns({c: F.col(c).cast("string") for c in ("seq", "next_offset")})
            initial = (initial if self.by == "partition" else initial.withColumn("shard", shard("home"))).groupBy(group)
        mode = "ProcessingTime" if self.timers else "None"
        records = as_records(rows) if self.by == "partition" else as_records(rows, shard("key").alias("shard"))
        done = records.groupBy(group).transformWithStateInPandas(PartitionProcessor(self.table, self.config.changelog, self.timers, self.by, self.block), OUTPUT, "Append", mode, initialState=initial)
        writer = done.writeStream.foreachBatch(sinks.once(self.root, self._after(then))).option("checkpointLocation", self.checkpoint).outputMode("append").queryName(f"{self.config.group_id}_{self.config.topic}")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{max(self.config.eos.batch_delay_ms, 1)} milliseconds")
        self.query = writer.start()

    def _after(self, then: Callable[[DataFrame, int], None] | None) -> Callable[[DataFrame, int], None] | None:
        """What follows the writing of a batch: the work of its jobs."""
        if not self.stages:
            return then

        def run(written: DataFrame, batch: int) -> None:
            self._jobs |= jobs.run(written, self.stages, self.root, batch, self.by)
            if then:
                then(written, batch)

        return run

    def pause(self) -> EventSource:
        """Take no more input until resume. The batch under way is dropped and done again then; no hook runs."""
        self._query().stop()
        return self

    def resume(self) -> EventSource:
        """Go on after pause, from the checkpoint."""
        if not self._query().isActive:
            self._run(*self._how)
        return self

    @property
    def state(self) -> str:
        return "healthy" if self.query is not None and self.query.isActive and self.query.exception() is None else "unhealthy"

    def wait(self, seconds: float | None = None) -> bool:
        """Until the query ends; its error, if any, goes through the policy for transactions."""
        try:
            ended = self._query().awaitTermination(seconds) if seconds else (self._query().awaitTermination() or True)
            while ended and self._how[0] and self._jobs:  # what came back from jobs is new input
                self._jobs = False
                self._run(*self._how)
                ended = self._query().awaitTermination(seconds) if seconds else (self._query().awaitTermination() or True)
            return ended
        except Exception as e:
            self.error = e
            answer = self.config.on_txn_error(e)
            log.error("the stream of %s failed: %s", self.config.topic, e)
            if answer is ErrorResponse.FATALLY_EXIT:
                raise
            return True

    def _query(self) -> StreamingQuery:
        if self.query is None:
            raise RuntimeError("not started")
        return self.query

    def stop(self) -> None:
        """Finish what is there, then stop."""
        while self.query is not None and self.query.isActive:
            self._jobs = False
            self.query.processAllAvailable()
            if not self._jobs:
                break
        self.stop_now()

    def stop_now(self) -> None:
        self._hook("on_will_revoke")
        if self.query is not None:
            self.query.stop()
        self.spark.streams.removeListener(self.metrics)
        self._hook("on_revoked")

    def wait_for_signals(self, before: Callable[[int], bool] | None = None, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGHUP)) -> None:
        """Block until a signal that `before` does not veto, then stop."""
        stop = threading.Event()
        old = {s: signal.signal(s, lambda n, _: stop.set() if before is None or before(n) else None) for s in signals}
        try:
            while not stop.wait(0.2) and self._query().isActive:
                pass
        finally:
            for s, f in old.items():
                signal.signal(s, f)
        self.stop()

    def wait_for(self, event: threading.Event) -> None:
        while not event.wait(0.2) and self._query().isActive:
            pass
        self.stop()

    def delete(self) -> None:
        """Delete checkpoint and outputs; for tests."""
        if self.query is not None and self.query.isActive:
            raise RuntimeError("the query is running")
        for path in (self.checkpoint, f"{self.root}/outputs", f"{self.root}/compacted", jobs.folder(self.root)):
            sinks.Folder(self.spark, path).delete()

    def store(self) -> DataFrame:
        """(group, key, value, record_type): every store as of the last committed batch, read beside the running query."""
        raw = self.spark.read.format("statestore").option("stateVarName", "items").load(self.checkpoint)
        return raw.select(self._of(), F.col("user_map_key.key").alias("item_key"), F.col("user_map_value.*")) if "user_map_key" in raw.columns else raw

    def _of(self) -> Column:
        """Whose an entry of a state is: its partition, or its key."""
        if self.by == "partition":
            return F.col("key.partition")
        return F.when(F.expr("substring(user_map_key.home, 1, 1)") == F.lit(KEY), F.expr("substring(user_map_key.home, 2)")).alias("key")

    def interject(self, partition: int, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """ask about one partition's store."""
        if self.by != "partition":
            raise ValueError("stores are by key")
        own = self.store().where(F.col("partition") == partition)
        if not 0 <= partition < self.config.num_partitions or not own.take(1):
            raise PartitionNotAssigned(partition)
        return ask(own)

    def interject_all(self, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """ask about all stores at once; the answer is one table, so there is nothing to wait for one by one."""
        return ask(self.store())
