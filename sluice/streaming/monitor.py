"""What running queries do, from Spark's own progress reports."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def metrics(progress: Any) -> dict[str, Any]:
    """A task's figures from one progress report: rows, rates, state, and time since the batch began."""
    return {
        "name": progress.name or str(progress.id),
        "batch": progress.batchId,
        "rows": progress.numInputRows,
        "rows_in_per_s": progress.inputRowsPerSecond,
        "rows_done_per_s": progress.processedRowsPerSecond,
        "state_rows": sum(s.numRowsTotal for s in progress.stateOperators),
        "batch_ms": progress.batchDuration,
    }


class PipelineMonitor:
    """Reports (name, current, total) of each watched query at an interval, until stopped.

    Queries that are registered after ``start`` are not watched; a second ``start`` changes nothing.
    """

    def __init__(self, spark: SparkSession, interval_s: float = 1.0, report: Callable[[dict], Any] = print) -> None:
        self.spark, self.interval_s, self.report = spark, interval_s, report
        self.names: set[str] = set()
        self.latest: dict[str, dict] = {}
        self.totals: dict[str, int] = {}
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self._lock = threading.Lock()
        self._listener = _Listener(self)

    def register(self, name: str) -> None:
        self.names.add(name)

    def start(self) -> None:
        if self._thread is not None:
            return
        watched = frozenset(self.names)
        self.spark.streams.addListener(self._listener)

        def run() -> None:
            while not self._stop.wait(self.interval_s):
                for line in self.snapshot(watched):
                    self.report(line)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def snapshot(self, watched: frozenset[str] | None = None) -> list[dict]:
        with self._lock:
            return [found | {"total_rows": self.totals[name], "at": time.time()} for name, found in sorted(self.latest.items()) if not watched or name in watched]

    def seen(self, progress: Any) -> None:
        found = metrics(progress)
        with self._lock:
            self.latest[found["name"]] = found
            self.totals[found["name"]] = self.totals.get(found["name"], 0) + found["rows"]

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self.spark.streams.removeListener(self._listener)
            self._thread.join()


class _Listener(StreamingQueryListener):
    def __init__(self, monitor: PipelineMonitor) -> None:
        self.monitor = monitor

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        self.monitor.seen(event.progress)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass
