"""Network sources as Spark data sources: ``spark.readStream.format("sluice_socket")``.

Options: ``kind`` (websocket, mqtt, microblog, firehose), ``url``, ``topic``, ``client_id``,
``token_variable`` (the environment variable that holds a microblog's token), ``wait_ms`` and
``max_rows`` of a micro-batch, ``on_error`` ("raise", or "empty" to end quietly).

A connection is read by a thread of the driver into a bounded queue; a full queue holds the
connection back. What was read is kept until Spark commits it, so a micro-batch that is run again
gets the same rows; what a connection lost before it was read is lost, as sockets do not replay.
Decoding is left to ``microblog.posts`` and ``firehose.posts``, which run on the executors.
"""

from __future__ import annotations

import os
import queue
import threading
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

QUEUE = 10_000


def _frames(options: dict) -> Iterator[tuple]:
    from . import firehose, microblog, websocket

    kind = options.get("kind", "websocket")
    if kind == "websocket":
        return ((t,) for t in websocket.text_frames(options.get("url", "ws://localhost:8080")))
    if kind == "mqtt":
        return ((t,) for t in websocket.mqtt_messages(options.get("url", "ws://localhost:8883"), options.get("topic", "test"), options.get("client_id", "test_client")))
    if kind == "microblog":
        token = os.environ.get(options["token_variable"]) if options.get("token_variable") else None
        url = options.get("stream_url") or microblog.stream_url(options.get("url", microblog.DEFAULT_SERVER), token)
        return ((t,) for t in websocket.text_frames(url))
    if kind == "firehose":
        return ((b,) for b in websocket.binary_frames(options.get("url", firehose.URL)))
    raise ValueError(f"unknown kind {kind}")


class SocketReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.kept: dict[int, list[tuple]] = {}
        self.rows: queue.Queue | None = None
        self.failed: Exception | None = None

    def _run(self) -> None:
        try:
            for row in _frames(self.options):
                self.rows.put(row)
        except Exception as e:
            if self.options.get("on_error", "raise") == "raise":
                self.failed = e
            else:
                print(f"source ended: {type(e).__name__}")

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[list[tuple], dict]:
        if self.rows is None:
            self.rows = queue.Queue(QUEUE)
            threading.Thread(target=self._run, daemon=True).start()
        if self.failed:
            raise self.failed
        most, wait = int(self.options.get("max_rows", 1000)), int(self.options.get("wait_ms", 200)) / 1000
        found, end = [], time.monotonic() + wait
        while len(found) < most and (left := end - time.monotonic()) > 0:
            try:
                found.append(self.rows.get(timeout=left))
            except queue.Empty:
                break
        at = start["at"]
        found = [(*row, at + i) for i, row in enumerate(found)]
        for row in found:
            self.kept[row[-1]] = row
        return found, {"at": at + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.kept[i] for i in range(start["at"], end["at"]) if i in self.kept])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["at"]]:
            del self.kept[i]


class SocketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sluice_socket"

    def schema(self) -> str:
        return "frame binary, seq bigint" if self.options.get("kind") == "firehose" else "value string, seq bigint"

    def simpleStreamReader(self, schema) -> SocketReader:
        return SocketReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SocketSource)


def stream(spark: SparkSession, kind: str, **options: str):
    """A stream of a live source's messages in the envelope, decoded on the executors; seq counts its frames."""
    from ..message import stream_envelope
    from . import firehose, microblog

    register(spark)
    raw = spark.readStream.format("sluice_socket").options(kind=kind, **options).load()
    if kind == "microblog":
        return stream_envelope(microblog.posts(raw), "payload", "event_ts", kind)
    if kind == "firehose":
        return stream_envelope(firehose.posts(raw), "payload", "event_ts", kind)
    return stream_envelope(raw, "value", source_id=kind)
