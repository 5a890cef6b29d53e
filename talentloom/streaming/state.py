"""Keyed state of the streams: which uploads are known, and in which status a document is.

State stands in RocksDB under the stream's checkpoint, a small value a key, so a batch
touches the keys that it brings and nothing that was stored before.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = ("UPLOADED", "FAILED")
DECISIONS = "document_id string, stored_id string, file string, reject_reason string"
MOVES = "key string, tie long, us long, status string, previous_status string"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class KnownUploads(StatefulProcessor):
    """A key is an upload's identity; its state, the stored document's id and status.

    Of the copies in a batch the one with the smallest id stands for all. It is
    passed on if it is new, or if the stored one waits or failed, then under the
    stored id. Rejected uploads are passed on each, and leave no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "stored_id string, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns, first = ["document_id", "stored_id", "file", "reject_reason"], None
        for frame in rows:
            bad = frame[frame["reject_reason"].notna()]
            if len(bad):
                yield bad.assign(stored_id=bad["document_id"])[columns]
            for r in frame[frame["reject_reason"].isna()].itertuples(index=False):
                if first is None or (r.document_id, r.file) < (first.document_id, first.file):
                    first = r
        if first is None:
            return
        stored = self.known.get() if self.known.exists() else None
        if stored is None or stored[1] in WAITING:
            name = first.document_id if stored is None else stored[0]
            self.known.update((name, first.status))
            yield pd.DataFrame([(first.document_id, name, first.file, None)], columns=columns)

    def close(self) -> None:
        pass


class StatusMoves(StatefulProcessor):
    """A key is a document; its state, the events that the watermark has not passed and the last status before them.

    Events are passed on in the order of time, tie and status once no earlier one can
    arrive. One timer a document waits for its earliest event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, tie long, status string")
        self.last = handle.getValueState("last", "status string")
        self.timer = handle.getValueState("timer", "at long")

    def _wait_for(self, events: list[tuple]) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = min(e[0] for e in events) // 1000
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [(int(r.us), int(r.tie), r.status) for frame in rows for r in frame.itertuples(index=False)]
        if events:
            events += [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
            self.waiting.put(events)
            self._wait_for(events)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted(tuple(e) for e in self.waiting.get())
        due = [e for e in events if -(-e[0] // 1000) <= passed]
        rest = events[len(due) :]
        self.timer.clear()
        if rest:
            self.waiting.put(rest)
            self._wait_for(rest)
        else:
            self.waiting.clear()
        before, out = self.last.get()[0] if self.last.exists() else None, []
        for us, tie, status in due:
            out.append((key[0], tie, us, status, before))
            before = status
        if due:
            self.last.update((before,))
            yield pd.DataFrame(out, columns=["key", "tie", "us", "status", "previous_status"])

    def close(self) -> None:
        pass
