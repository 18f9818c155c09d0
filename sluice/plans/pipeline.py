"""Pipelines: sources and stages joined by ``|``, compiled to one DataFrame or streaming query.

A pipeline is a value; nothing runs before ``run``, ``dataframe`` or ``start``. Stages name the kind
of payload that they take and give, and ``|`` refuses stages that do not fit. Kinds: ``text``,
``batch`` (an array), ``value`` (anything else), ``any``.

Kept from the model that it follows: lanes feed lanes by number unless a splitter deals messages;
combined sources all arrive in lane 0; a pipeline that is started as a stream ends in a sink. Made
otherwise on purpose: composition starts nothing, errors reach the caller, a second ``combine`` adds
to the first, and stages that do not fit raise TypeError.
"""

from __future__ import annotations

import copy
import functools
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.regex import to_java
from ..message import reset
from ..operators import embed, filters, folds, lanes, maps, windows


@dataclass(frozen=True)
class Stage:
    """A function on message frames, with the kinds that it takes and gives and its slots."""

    name: str
    apply: Callable[[DataFrame, int], DataFrame]
    takes: str = "any"
    gives: str = "same"
    slots: int = 1
    sink: bool = False

    def __post_init__(self) -> None:
        if self.slots < 1:
            raise ValueError("a stage needs one slot at least")

    def with_slots(self, n: int) -> Stage:
        return replace(self, slots=n)


@dataclass(frozen=True)
class Pipeline:
    """A source, and the stages after it."""

    source: DataFrame
    kind: str = "text"
    stages: tuple[Stage, ...] = ()
    others: tuple[Pipeline, ...] = ()
    reorder: tuple[str, ...] = ()

    def __or__(self, stage: Stage) -> Pipeline:
        if not isinstance(stage, Stage):
            raise TypeError(f"{type(stage).__name__} is not a stage")
        if self.stages and self.stages[-1].sink:
            raise TypeError(f"nothing can follow the sink {self.stages[-1].name}")
        if "any" not in (stage.takes, self.kind) and stage.takes != self.kind:
            raise TypeError(f"{stage.name} takes {stage.takes} and not {self.kind}")
        kind = self.kind if stage.gives == "same" else stage.gives
        return replace(self, stages=(*self.stages, stage), kind=kind)

    def combine(self, *others: Pipeline, reorder: tuple[str, ...] = ()) -> Pipeline:
        """More sources of the same kind; allowed before the first stage, and again and again."""
        if self.stages:
            raise TypeError("sources are combined before the first stage")
        for other in others:
            if "any" not in (other.kind, self.kind) and other.kind != self.kind:
                raise TypeError(f"a source of {other.kind} cannot join one of {self.kind}")
        return replace(self, others=(*self.others, *others), reorder=reorder or self.reorder)

    def dataframe(self) -> DataFrame:
        """The frame of the last stage that is no sink."""
        df = self.source
        if self.others:
            reorder = () if df.isStreaming else self.reorder
            df = lanes.combine(df, *[o.dataframe() for o in self.others], reorder=reorder)
        slots = 1
        for stage in self.stages:
            if stage.sink:
                break
            if stage.name not in ("split", "merge") and "slot" in df.columns:
                df = lanes.between_stages(df, slots, stage.slots)
            df = stage.apply(df, stage.slots)
            slots = stage.slots
        return df

    def run(self) -> Any:
        """Bounded: gives the frame to the sink and returns what the sink returns, or the frame."""
        df = self.dataframe()
        if df.isStreaming:
            return self.start().awaitTermination()
        return self.stages[-1].apply(df, 1) if self.stages and self.stages[-1].sink else df

    def start(self, checkpoint: str | None = None, available_now: bool = True, output_mode: str = "append", name: str | None = None) -> StreamingQuery:
        """Unbounded: starts the streaming query into the sink; ``name`` is what a monitor knows it by."""
        if not (self.stages and self.stages[-1].sink):
            raise TypeError("a stream has to end in a sink")
        writer = self.dataframe().writeStream.outputMode(output_mode).foreachBatch(lambda batch, _: self.stages[-1].apply(batch, 1))
        if name:
            writer = writer.queryName(name)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def filter_pattern(pattern: str = ".*") -> Stage:
    if pattern == ".*":
        return Stage("filter", lambda df, _: filters.everything(df), "text")
    to_java(pattern)
    return Stage("filter", lambda df, _: filters.by_pattern(df, pattern), "text")


def filter_where(predicate: Column | Callable[[Column], Column]) -> Stage:
    return Stage("filter", lambda df, _: filters.by_predicate(df, predicate))


def filter_function(test: Callable[[str], bool]) -> Stage:
    return Stage("filter", lambda df, _: filters.by_callable(df, test), "text")


def map_column(expression: Column | Callable[[Column], Column], gives: str = "value") -> Stage:
    return Stage("map", lambda df, _: maps.by_column(df, expression), "any", gives)


def map_function(function: Callable[[Any], Any], returns: str, gives: str = "value") -> Stage:
    return Stage("map", lambda df, _: maps.by_callable(df, function, returns), "any", gives)


def reduce_running(operation: str, initial: Any = None) -> Stage:
    """sum, count, min or max so far, after each message, over all slots."""

    def apply(df: DataFrame, _: int) -> DataFrame:
        if not df.isStreaming:
            return folds.running(df, operation, initial=initial)
        kind = "bigint" if operation == "count" else folds.total_type(df.schema["payload"].dataType, operation)
        return _folded(df, folds.STEPS[operation], initial if initial is not None or operation != "count" else 0, kind, False)

    return Stage("reduce", apply, "any", "value")


def _folded(df: DataFrame, step: Callable[[Any, Any], Any], initial: Any, returns: str, keep_on_error: bool) -> DataFrame:
    """A fold over bounded or unbounded messages, as new messages of slot 0."""
    if df.isStreaming:
        from ..streaming.stateful import running_fold

        made = running_fold(df, step, initial, returns, keep_on_error)
    else:
        made = folds.running_by(df, step, initial, returns, keep_on_error)
    return reset(made.withColumn("slot", F.lit(0)))


def reduce_function(step: Callable[[Any, Any], Any], initial: Any, returns: str, keep_on_error: bool = False) -> Stage:
    return Stage("reduce", lambda df, _: _folded(df, step, initial, returns, keep_on_error), "any", "value")


def reduce_each(step: Callable[[Any, Any], Any], initial: Any, returns: str) -> Stage:
    """The fold of each window's messages by itself: its state starts anew with every window."""

    def fold(batch: Any) -> Any:
        return functools.reduce(step, batch if batch is not None else (), copy.deepcopy(initial))

    return Stage("reduce", lambda df, _: reset(maps.by_callable(df, fold, returns)), "batch", "value")


def _windowed(df: DataFrame, slots: int) -> DataFrame:
    """Windows as messages: in the order of their number and slot."""
    if not df.isStreaming:
        slots = max(slots, int(df.agg(F.max("slot")).first()[0] or 0) + 1)
    return reset(df.withColumn("seq", F.col("win") * slots + F.col("slot")))


def window_count(n: int = 10) -> Stage:
    def apply(df: DataFrame, slots: int) -> DataFrame:
        if df.isStreaming:
            from ..streaming.stateful import count_windows

            return _windowed(count_windows(df, n), slots)
        return _windowed(windows.count_window(df, n), slots)

    return Stage("window", apply, "any", "batch")


def window_duration(duration_ms: int, start_ms: int = 0) -> Stage:
    """``start_ms`` is where the clock of a replay starts, bounded or a stream with ``arrival_ms``; of a live stream it is its first batch."""

    def apply(df: DataFrame, slots: int) -> DataFrame:
        if df.isStreaming:
            from ..streaming.stateful import time_windows

            return _windowed(time_windows(df, duration_ms, start_ms if "arrival_ms" in df.columns else None), slots)
        return _windowed(windows.time_window(with_times(df), duration_ms, start_ms), slots)

    return Stage("window", apply, "any", "batch")


def window_sliding(size_ms: int, slide_ms: int, start_ms: int = 0) -> Stage:
    def apply(df: DataFrame, slots: int) -> DataFrame:
        if df.isStreaming:
            from ..streaming.stateful import sliding_windows

            return _windowed(sliding_windows(df, size_ms, slide_ms, start_ms if "arrival_ms" in df.columns else None), slots)
        return _windowed(windows.sliding_window(with_times(df), size_ms, slide_ms, start_ms), slots)

    return Stage("window", apply, "any", "batch")


def with_times(df: DataFrame) -> DataFrame:
    """arrival_ms and event_ms of messages: what a replay brings, or the envelope's own times."""
    made = {"arrival_ms": F.unix_millis("ingest_ts"), "event_ms": F.unix_millis("event_ts")}
    return df.withColumns({k: v for k, v in made.items() if k not in df.columns})


def splitter(slots: int) -> Stage:
    if slots < 2:
        raise ValueError("a splitter needs more than one slot")
    return Stage("split", lambda df, n: lanes.split_round_robin(df, n), slots=slots)


def merger() -> Stage:
    return Stage("merge", lambda df, _: lanes.merge(df))


def embedder(client: embed.Client, batched: bool = True) -> Stage:
    if batched:
        return Stage("embed", lambda df, _: embed.embed_batches(df, client), "batch", "value")
    return Stage("embed", lambda df, _: embed.embed_texts(df, client), "text", "value")


def transform(function: Callable[[DataFrame], DataFrame], takes: str = "any", gives: str = "value") -> Stage:
    """A stage of one's own: any function on message frames, with 0 to n messages out for each in."""
    return Stage(getattr(function, "__name__", "transform"), lambda df, _: function(df), takes, gives)


class Collected(list):
    """What a collecting sink was given, in the order of slot and seq."""

    def __init__(self) -> None:
        super().__init__()
        self._lock = threading.Lock()

    def take(self, df: DataFrame) -> Collected:
        order = [c for c in ("slot", "seq", "win") if c in df.columns]
        rows = [r["payload"] for r in (df.orderBy(*order) if order else df).select("payload").collect()]
        with self._lock:
            self.extend(rows)
        return self


class Kept:
    """What a sink was given, kept by the executors in a shared folder: the driver holds none of it, however much it is.

    A batch of a stream comes after those before it; within a batch the order is that of slot and seq.
    """

    def __init__(self, path: str) -> None:
        self.path, self._batches, self._lock = path, 0, threading.Lock()

    def take(self, df: DataFrame, call: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Kept:
        """Keeps the payloads, or what ``call`` makes of the ordered rows; it may leave rows out, but not move them."""
        with self._lock:
            batch, self._batches = self._batches, self._batches + 1
        order = [c for c in ("slot", "seq", "win") if c in df.columns]
        rows = call((df.orderBy(*order) if order else df).select("payload"))
        # Ids are the part of the order and the place in it, so parts need not know of each other.
        rows.select(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("at"), "payload").write.mode("append").parquet(self.path)
        return self

    def dataframe(self, spark: SparkSession) -> DataFrame:
        """(place, payload): what is kept, with its place from 0."""
        rows = spark.read.parquet(self.path).withColumn("part", F.shiftright("at", 33))
        sizes = rows.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("size"))
        before = Window.orderBy("batch", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
        starts = sizes.select("batch", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
        place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
        return rows.join(F.broadcast(starts), ["batch", "part"]).select(place.alias("place"), "payload")


def collect_into(found: Collected | Kept) -> Stage:
    """``Collected`` is a list on the driver, for small results; ``Kept`` is for any."""
    return Stage("collect", lambda df, _: found.take(df), gives="none", sink=True)
