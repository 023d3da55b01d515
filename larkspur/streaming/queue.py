"""The ingest queue as state: order, files at work, deadlines and tries, kept by the stream's checkpoint.

Events ``queue, file_id, kind, error, at`` come in; ``kind`` is ``enqueue``, ``done`` or
``failed``.  Commands come out: ``start`` a file, or mark it ``failed`` with a text.  A queue
starts waiting files in the order in which they came, at most ``workers`` at a time.  A
file that reports a failure waits again until its ``tries`` are used up; one that reports nothing for
``limit`` seconds has failed.  One file's failure touches no other.  Queues, such as
one per tenant, are independent keys; state lives in the state store, so a restarted stream
goes on where the checkpoint is.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

EVENT = "queue string, file_id string, kind string, error string, at timestamp"
COMMAND = "queue string, file_id string, action string, tries int, error string"
#: What the state store has to be.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMED_OUT = "Ingestion timed out after {:g}s"


def _ddl(text: str) -> StructType:
    return StructType.fromDDL(text)


class FileQueue(StatefulProcessor):
    def __init__(self, workers: int, limit: float, tries: int) -> None:
        self.workers, self.limit, self.tries = workers, limit, tries
        self.schemas = _ddl("file_id string, tries int"), _ddl("file_id string"), _ddl("tries int, until bigint")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.working = handle.getMapState("working", self.schemas[1], self.schemas[2])

    def _start(self, key: tuple, now: int, lines: list[tuple[str, int]], out: list[tuple]) -> None:
        """Start waiting files while there is room, and keep the rest."""
        room = self.workers - sum(1 for _ in self.working.keys())
        for file_id, tried in lines[: max(room, 0)]:
            until = now + int(self.limit * 1000)
            self.working.updateValue((file_id,), (tried, until))
            self.handle.registerTimer(until)
            out.append((key[0], file_id, "start", tried, None))
        left = lines[max(room, 0) :]
        self.waiting.clear()
        if left:
            self.waiting.put(left)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        lines = [(r[0], r[1]) for r in self.waiting.get()]
        events = pd.concat(list(rows)).sort_values(["at", "file_id"], kind="stable")
        for event in events.itertuples():
            at_work = self.working.containsKey((event.file_id,))
            if event.kind == "enqueue" and not at_work and event.file_id not in {f for f, _ in lines}:
                lines.append((event.file_id, 1))
            elif event.kind in ("done", "failed") and at_work:
                tried = self.working.getValue((event.file_id,))[0]
                self.working.removeKey((event.file_id,))
                if event.kind == "failed" and tried < self.tries:
                    lines.append((event.file_id, tried + 1))
                elif event.kind == "failed":
                    out.append((key[0], event.file_id, "failed", tried, event.error or "Unexpected ingestion error"))
        self._start(key, now, lines, out)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        late = [(k[0], v[0]) for k, v in self.working.iterator() if v[1] <= now]
        for file_id, tried in late:
            self.working.removeKey((file_id,))
            out.append((key[0], file_id, "failed", tried, TIMED_OUT.format(self.limit)))
        if late:
            self._start(key, max(now, int(datetime.now(timezone.utc).timestamp() * 1000)), [(r[0], r[1]) for r in self.waiting.get()], out)
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["queue", "file_id", "action", "tries", "error"]).astype({"tries": "int32"})

    def close(self) -> None:
        pass


def commands(events: DataFrame, workers: int = 3, limit: float = 900, tries: int = 3) -> DataFrame:
    """Commands for a stream of ``EVENT`` rows.  The session's state store has to be ``PROVIDER``."""
    return events.groupBy("queue").transformWithStateInPandas(
        statefulProcessor=FileQueue(workers, limit, tries), outputStructType=_ddl(COMMAND), outputMode="append", timeMode="ProcessingTime"
    )
