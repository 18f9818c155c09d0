"""Windows and folds over unbounded messages, with their state in Spark's state store.

A message has ``slot`` and ``payload``; ``seq`` orders the messages of a micro-batch, ``arrival_ms`` and
``event_ms`` are used where given, else the clock of the micro-batch. State is keyed by slot (folds:
one key), lives in the state store and is checkpointed with the query. A processor is not told of a
stream's end, so a row with ``last`` true stands for it: it is no message, and flushes its slot.

Triggers are looked at when a message comes and never by a timer, which is why time mode "None" will do.
"""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

_HELD = StructType([StructField("seq", LongType()), StructField("event_ms", LongType()), StructField("payload", StringType())])
_CLOCK = StructType([StructField("trigger", LongType()), StructField("win", LongType())])


def _batch(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All of a key's rows of a micro-batch, in order; they may come in several unordered parts."""
    found = pd.concat(list(rows), ignore_index=True)
    return found.sort_values(["last", "seq"], kind="stable")


def _plain(value: Any) -> Any:
    return value.tolist() if hasattr(value, "tolist") else value


class _Windows(StatefulProcessor):
    """Buffers a slot's messages; subclasses say when and what to emit."""

    def __init__(self, start_ms: int | None) -> None:
        self.start_ms = start_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _HELD)
        self.clock = handle.getValueState("clock", _CLOCK)

    def due(self, held: list, arrival: int, trigger: int) -> bool:
        raise NotImplementedError

    def emitted(self, held: list, arrival: int) -> tuple[list, list]:
        """What a trigger emits, and what stays."""
        return held, []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        now = int(time.time() * 1000)
        trigger, win = self.clock.get() if self.clock.exists() else (now if self.start_ms is None else self.start_ms, 0)
        out: list[tuple[int, list]] = []
        for row in _batch(rows).itertuples(index=False):
            arrival = now if pd.isna(row.arrival_ms) else int(row.arrival_ms)
            if row.last:
                group, held = held, []
            else:
                held.append((int(row.seq), arrival if pd.isna(row.event_ms) else int(row.event_ms), json.dumps(_plain(row.payload))))
                if not self.due(held, arrival, trigger):
                    continue
                group, held = self.emitted(held, arrival)
                trigger = arrival
            if group:
                out.append((win, [json.loads(p) for _, _, p in group]))
                win += 1
        if held:
            self.held.put(held)
        elif self.held.exists():
            self.held.clear()
        self.clock.update((trigger, win))
        if out:
            yield pd.DataFrame({"slot": [key[0]] * len(out), "win": [w for w, _ in out], "payload": [p for _, p in out]})

    def close(self) -> None:
        pass


class CountWindows(_Windows):
    def __init__(self, n: int) -> None:
        super().__init__(0)
        self.n = max(n, 1)

    def due(self, held: list, arrival: int, trigger: int) -> bool:
        return len(held) >= self.n


class TimeWindows(_Windows):
    def __init__(self, duration_ms: int, start_ms: int | None) -> None:
        super().__init__(start_ms)
        self.duration_ms = duration_ms

    def due(self, held: list, arrival: int, trigger: int) -> bool:
        return arrival >= trigger + self.duration_ms


class SlidingWindows(_Windows):
    def __init__(self, size_ms: int, slide_ms: int, start_ms: int | None) -> None:
        super().__init__(start_ms)
        self.size_ms, self.slide_ms = size_ms, slide_ms

    def due(self, held: list, arrival: int, trigger: int) -> bool:
        return arrival >= trigger + self.slide_ms

    def emitted(self, held: list, arrival: int) -> tuple[list, list]:
        left = [h for h in held if h[1] >= max(0, arrival - self.size_ms)]
        return left, left


def _shaped(df: DataFrame) -> DataFrame:
    made = {"seq": F.lit(0).cast("bigint"), "arrival_ms": F.lit(None).cast("bigint"), "event_ms": F.lit(None).cast("bigint"), "last": F.lit(False), "slot": F.lit(0)}
    df = df.withColumns({k: c for k, c in made.items() if k not in df.columns})
    return df.select(F.col("slot").cast("int").alias("slot"), "seq", "arrival_ms", "event_ms", F.coalesce("last", F.lit(False)).alias("last"), "payload")


def _windowed(df: DataFrame, processor: StatefulProcessor) -> DataFrame:
    kind = df.schema["payload"].dataType
    schema = StructType([StructField("slot", IntegerType()), StructField("win", LongType()), StructField("payload", ArrayType(kind))])
    return _shaped(df).groupBy("slot").transformWithStateInPandas(processor, schema, "Append", "None")


def count_windows(df: DataFrame, n: int = 10) -> DataFrame:
    """(slot, win, payload): every nth message of a slot ends a window."""
    return _windowed(df, CountWindows(n))


def time_windows(df: DataFrame, duration_ms: int, start_ms: int | None = None) -> DataFrame:
    """Tumbling windows by arrival; without ``start_ms`` a slot's clock starts with its first batch."""
    return _windowed(df, TimeWindows(duration_ms, start_ms))


def sliding_windows(df: DataFrame, size_ms: int, slide_ms: int, start_ms: int | None = None) -> DataFrame:
    """Sliding windows by arrival; event times decide what is left out."""
    return _windowed(df, SlidingWindows(size_ms, slide_ms, start_ms))


class RunningFold(StatefulProcessor):
    """The state of a fold after every message; the state is kept as JSON."""

    def __init__(self, step: Callable[[Any, Any], Any], initial: Any, keep_on_error: bool) -> None:
        self.step, self.initial, self.keep_on_error = step, initial, keep_on_error

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else copy.deepcopy(self.initial)
        seqs, made = [], []
        for row in _batch(rows).itertuples(index=False):
            if row.last:
                continue
            try:
                state = self.step(state, _plain(row.payload))
            except Exception as e:
                if not self.keep_on_error:
                    raise
                print(f"reduce failed: {e}")
            seqs.append(int(row.seq))
            made.append(copy.deepcopy(state))
        self.state.update((json.dumps(state),))
        if made:
            yield pd.DataFrame({"seq": seqs, "payload": pd.Series(made, dtype=object)})

    def close(self) -> None:
        pass


class Numbered(StatefulProcessor):
    """Messages numbered from 0 as they come; the next number is the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", StructType([StructField("seq", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        for batch in rows:
            yield batch.drop(columns="__key", errors="ignore").assign(seq=range(at, at + len(batch)))
            at += len(batch)
        self.next.update((at,))

    def close(self) -> None:
        pass


def numbered(df: DataFrame) -> DataFrame:
    """Messages of a stream with ``seq``, for stages that go by it. One count is one task, as for a splitter it has to be."""
    schema = StructType([*df.schema.fields, StructField("seq", LongType())])
    return df.withColumn("__key", F.lit(0)).groupBy("__key").transformWithStateInPandas(Numbered(), schema, "Append", "None")


def running_fold(df: DataFrame, step: Callable[[Any, Any], Any], initial: Any, returns: str, keep_on_error: bool = False) -> DataFrame:
    """(seq, payload) of a fold over all slots: one state, as the slots of a fold share it."""
    one = _shaped(df).withColumn("slot", F.lit(0))
    return one.groupBy("slot").transformWithStateInPandas(RunningFold(step, initial, keep_on_error), f"seq bigint, payload {returns}", "Append", "None")
