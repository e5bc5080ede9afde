"""Retry timers: schedules of a ledger's stream that fire when their time has come.

State is kept by run in maps that are read and written an entry at a time: the schedules that wait,
by name, and the names by due time.  A schedule registers a processing-time timer for its
``notBeforeAt``; a start or a cancel takes it away.  So a micro-batch writes as much state as it
has schedules, starts and cancels, whatever the run has seen before.

The state store must be RocksDB's (``STORE``), as for every keyed map state.  A schedule whose time
has passed when it arrives fires with the next batch.  Repeated names, and starts of unknown
ones, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Session setting and value that keyed map state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DUE = "run_id string, schedule_id string, kind string, operation string, due_at timestamp, fired_at timestamp"
_FIELDS = "scheduleId string, logicalOperationId string, logicalRequestId string, notBeforeAt string"


def timed(events: DataFrame) -> DataFrame:
    """The events (EVENT) that move a timer: rows (run_id, seq, type, schedule_id, operation, due_ms)."""
    p = F.from_json("payload", _FIELDS)
    moves = events.filter(F.col("type").isin("retry_scheduled", "request_retry_scheduled", "retry_started", "request_retry_started", "cancel_requested")).withColumn("p", p)
    return moves.select("run_id", "seq", "type", F.col("p.scheduleId").alias("schedule_id"), F.coalesce("p.logicalOperationId", "p.logicalRequestId").alias("operation"),
                        F.unix_millis(F.try_to_timestamp("p.notBeforeAt")).alias("due_ms"))


class RetryTimers(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "schedule_id string", "kind string, operation string, due_ms bigint")
        self.due = handle.getMapState("due", "due_ms bigint", "schedule_ids string")

    def _forget(self, name: str) -> None:
        if not self.waiting.containsKey((name,)):
            return
        due = self.waiting.getValue((name,))[2]
        self.waiting.removeKey((name,))
        left = [x for x in self.due.getValue((due,))[0].split("\n") if x != name]
        if left:
            self.due.updateValue((due,), ("\n".join(left),))
        else:
            self.due.removeKey((due,))
            self.handle.deleteTimer(due)

    def _wait(self, name: str, kind: str, operation: str, due: int) -> None:
        if self.waiting.containsKey((name,)):
            return
        self.waiting.updateValue((name,), (kind, operation, due))
        known = self.due.getValue((due,))[0] + "\n" if self.due.containsKey((due,)) else ""
        self.due.updateValue((due,), (known + name,))
        self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if r.type == "cancel_requested":
                for name in [k[0] for k in self.waiting.keys()]:
                    self._forget(name)
            elif r.schedule_id is None:
                continue
            elif r.type.endswith("scheduled"):
                if pd.notna(r.due_ms):
                    self._wait(r.schedule_id, "attempt" if r.type == "retry_scheduled" else "request", r.operation, int(r.due_ms))
            else:
                self._forget(r.schedule_id)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not self.due.containsKey((due,)):
            return
        names = self.due.getValue((due,))[0].split("\n")
        at = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)
        told = []
        for name in names:
            kind, operation, _ = self.waiting.getValue((name,))
            told.append((key[0], name, kind, operation, at(due), at(timerValues.getCurrentProcessingTimeInMs())))
            self.waiting.removeKey((name,))
        self.due.removeKey((due,))
        yield pd.DataFrame(told, columns=["run_id", "schedule_id", "kind", "operation", "due_at", "fired_at"])

    def close(self) -> None:
        pass


def due_schedules(events: DataFrame) -> DataFrame:
    """The stream of schedules (DUE) whose time has come and that were neither started nor cancelled."""
    return timed(events).groupBy("run_id").transformWithStateInPandas(RetryTimers(), DUE, "append", "processingTime")
