"""Classes for pipelines of Python functions: text in, batches by time, maps, folds, a collector.

Which may follow which: a source, ``Filter`` and ``PipelineComponent`` are followed by
``PipelineComponent``, ``Filter`` or ``Window``; ``Window`` by ``Map`` or ``Reduce``; ``Map`` by
``Reduce`` (which then gets an empty list for whatever is no list of texts) or ``Collector``;
``Reduce`` by ``Collector``; ``Collector`` by nothing. All else raises TypeError.

Functions that raise do not end the pipeline: a filter takes it as no, a map as an empty list, a fold
leaves its state and passes it on, a component drops the message, a collector skips it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..functions.regex import to_java
from ..operators import maps
from ..streaming.sinks import collector
from .pipeline import Pipeline, Stage, filter_function, filter_pattern, reduce_function, window_duration

_AFTER = {
    "Source": ("PipelineComponent", "Filter", "Window"),
    "Filter": ("PipelineComponent", "Filter", "Window"),
    "PipelineComponent": ("PipelineComponent", "Filter", "Window"),
    "Window": ("Map", "Reduce"),
    "Map": ("Reduce", "Collector"),
    "Reduce": ("Collector",),
    "Collector": (),
}


class Step:
    """A class of this module; joined by ``|`` to what comes before it."""

    def stage(self, before: Step) -> Stage:
        raise NotImplementedError


class Flow:
    """A source with the steps after it."""

    def __init__(self, pipeline: Pipeline, last: Step) -> None:
        self.pipeline, self.last = pipeline, last

    def __or__(self, step: Step) -> Flow:
        before, after = type(self.last).__name__, type(step).__name__
        if after not in _AFTER[before]:
            raise TypeError(f"{after} cannot follow {before}")
        return Flow(self.pipeline | step.stage(self.last), step)

    def run(self) -> Any:
        """Runs to the end; a stream runs until it has no more input at hand."""
        if self.pipeline.source.isStreaming:
            return self.pipeline.start().awaitTermination()
        return self.pipeline.run()


class Source(Step):
    """Messages of text, bounded or unbounded."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def __or__(self, step: Step) -> Flow:
        return Flow(Pipeline(self.df), self) | step


class Filter(Step):
    def __init__(self, pattern: str) -> None:
        to_java(pattern)
        self._stage = filter_pattern(pattern)

    @classmethod
    def with_lambda(cls, test: Callable[[str], bool]) -> Filter:
        made = cls.__new__(cls)
        made._stage = filter_function(test)
        return made

    def stage(self, before: Step) -> Stage:
        return self._stage


class PipelineComponent(Step):
    def __init__(self, function: Callable[[str], Any]) -> None:
        self.function = function

    def stage(self, before: Step) -> Stage:
        return Stage("component", lambda df, _: maps.text_or_nothing(df, self.function), "text", "text")


class Window(Step):
    """Batches of what arrives within the time; ``start_ms`` is the clock's start in a replay."""

    def __init__(self, duration_ms: int, start_ms: int = 0) -> None:
        self.duration_ms, self.start_ms = duration_ms, start_ms

    def stage(self, before: Step) -> Stage:
        return window_duration(self.duration_ms, self.start_ms)


class Map(Step):
    """A function of a batch, with its result's type; an exception gives an empty list where that is a list."""

    def __init__(self, function: Callable[[list[str]], Any], returns: str = "array<string>") -> None:
        self.function, self.returns = function, returns

    def stage(self, before: Step) -> Stage:
        return Stage("map", lambda df, _: maps.batches_or_empty(df, self.function, self.returns), "batch", "value")


class Reduce(Step):
    def __init__(self, initial: Any, function: Callable[[Any, list[str]], Any], returns: str) -> None:
        self.initial, self.function, self.returns = initial, function, returns

    def stage(self, before: Step) -> Stage:
        function = self.function

        def step(state: Any, payload: Any) -> Any:
            payload = payload.tolist() if hasattr(payload, "tolist") else payload
            texts = payload if isinstance(payload, list) and all(isinstance(x, str) for x in payload) else []
            return function(state, texts)

        return reduce_function(step, self.initial, self.returns, keep_on_error=True)


class Collector(Step):
    def __init__(self, callback: Callable[[Any], Any]) -> None:
        self.callback = callback

    def stage(self, before: Step) -> Stage:
        return collector(self.callback)
