"""Metrics of a stream: a row for each committed batch, kept in a bounded queue."""

from __future__ import annotations

import logging
from collections import deque
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)
QUEUE = 2048


@dataclass(frozen=True)
class Metric:
    operation: str
    topic: str
    group_id: str
    start: str
    batch: int
    count: int
    duration_ms: int
    execute_ms: int

    @property
    def linger_ms(self) -> int:
        """Time beside execution."""
        return max(0, self.duration_ms - self.execute_ms)


class Metrics(StreamingQueryListener):
    def __init__(self, topic: str, group_id: str):
        super().__init__()
        self.topic, self.group_id, self.rows, self.dropped = topic, group_id, deque(), 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if p.name != f"{self.group_id}_{self.topic}":
            return
        if len(self.rows) >= QUEUE:
            self.dropped += 1
            log.warning("the queue of metrics is full; one is dropped")
            return
        d = p.durationMs
        self.rows.append(Metric("TxnCommit", self.topic, self.group_id, p.timestamp, p.batchId, p.numInputRows, int(d.get("triggerExecution", 0)), int(d.get("addBatch", 0))))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
