"""Streams against bounded runs of the same messages, sinks, the monitor, and the callable classes."""

import time

import pytest
from pyspark.sql import functions as F

from sluice.operators import folds, windows
from sluice.plans import callables
from sluice.operators import embed
from sluice.plans.pipeline import Collected, Pipeline, collect_into, embedder, filter_pattern, map_column, merger, reduce_each, reduce_function, reduce_running, splitter, window_count, window_duration
from sluice.sources import files, fixtures
from sluice.streaming import monitor, sinks, stateful

SCHEMA = "seq bigint, payload string, arrival_ms bigint, event_ms bigint, slot int, last boolean"


@pytest.fixture
def stream(spark, tmp_path):
    """Messages in files, one a micro-batch, the last with end markers for both slots."""

    def make(items, per_file=3):
        rows = [(i, p, a, a if e is None else e, i % 2, False) for i, (p, a, e) in enumerate(items)]
        path = tmp_path / "in"
        for k in range(0, len(rows), per_file):
            part = rows[k : k + per_file]
            if k + per_file >= len(rows):
                part = part + [(10**9, "", None, None, s, True) for s in (0, 1)]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))
        return df, spark.createDataFrame(rows, SCHEMA)

    return make


def run(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name)


ITEMS = [(f"m{i}", i * 170, None if i % 4 else max(0, i * 170 - 700)) for i in range(14)]


@pytest.mark.parametrize("kind", ["count", "time", "sliding"])
def test_stream_windows_equal_bounded_ones(spark, stream, tmp_path, kind):
    df, rows = stream(ITEMS)
    if kind == "count":
        got, want = stateful.count_windows(df, 3), windows.count_window(rows, 3)
    elif kind == "time":
        got, want = stateful.time_windows(df, 500, 0), windows.time_window(rows, 500)
    else:
        got, want = stateful.sliding_windows(df, 600, 400, 0), windows.sliding_window(rows, 600, 400)
    shown = lambda t: sorted((r.slot, r.win, r.payload) for r in t.collect())
    assert shown(run(got, f"windows_{kind}", tmp_path)) == shown(want)


def test_stream_fold_equals_bounded_one(spark, stream, tmp_path):
    df, rows = stream(ITEMS)
    step = lambda a, x: (a * 3 + len(x)) % 1009
    shown = lambda t: sorted((r.seq, r.payload) for r in t.collect())
    assert shown(run(stateful.running_fold(df, step, 0, "bigint"), "fold", tmp_path)) == shown(folds.running_by(rows, step, 0, "bigint"))


def test_event_time_windows_on_a_stream(spark, stream, tmp_path):
    df, rows = stream(ITEMS)
    timed = lambda t: t.filter("not last").withColumn("event_ts", F.timestamp_millis("event_ms"))
    want = {r["window"].start: sorted(r.payload) for r in windows.event_tumbling(timed(rows), "1 second").collect()}
    made = windows.event_tumbling(timed(df), "1 second")
    query = made.writeStream.format("memory").queryName("event_windows").option("checkpointLocation", str(tmp_path / "e")).outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r["window"].start: sorted(r.payload) for r in spark.table("event_windows").collect()} == want


def test_stream_pipeline_into_a_sink(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo\nthree\n")
    source = files.text_stream(spark, str(folder))
    found = Collected()
    query = (Pipeline(source) | filter_pattern("^t") | collect_into(found)).start(str(tmp_path / "c"))
    assert query.awaitTermination(120)
    assert sorted(found) == ["three", "two"]
    with pytest.raises(TypeError):
        (Pipeline(source) | filter_pattern("x")).start()


def test_stream_of_counted_windows_in_a_pipeline(spark, stream, tmp_path):
    df, rows = stream(ITEMS)
    found = Collected()
    query = (Pipeline(df) | window_count(3).with_slots(2) | collect_into(found)).start(str(tmp_path / "c"))
    assert query.awaitTermination(120)
    assert sum(len(x) for x in found) == len(ITEMS)


def counted(counts, words):
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return counts


def streamed(flow, tmp_path, name):
    found = Collected()
    query = (flow | collect_into(found)).start(str(tmp_path / name))
    assert query.awaitTermination(180)
    return list(found)


TEXTS = [(f"w{i % 3} w{i % 4} x", i * 170, None) for i in range(14)]


def test_words_of_two_sources_are_counted_by_window_on_a_stream(spark, stream, tmp_path):
    """combine | filter | words | window | counts of each window, and counts so far."""
    df, rows = stream(TEXTS)
    df, rows = (t.withColumn("slot", F.lit(0)) for t in (df, rows))
    other = df.filter("false").drop("seq", "slot")

    def flow(source, last):
        words = map_column(lambda p: F.split(p, " "), "value")
        return source | filter_pattern("w[0-2]|^$") | words | window_duration(500) | last

    for name, last in (
        ("each", lambda: reduce_each(counted, {}, "map<string,bigint>")),
        ("far", lambda: reduce_function(lambda s, batch: [counted(s, ws) for ws in batch][-1], {}, "map<string,bigint>")),
    ):
        want = [r.payload for r in flow(Pipeline(rows), last()).dataframe().orderBy("seq").collect()]
        got = streamed(flow(Pipeline(df).combine(Pipeline(other)), last()), tmp_path, name)
        assert len(want) > 2 and sorted(map(str, (sorted(x.items()) for x in got))) == sorted(map(str, (sorted(x.items()) for x in want)))


def test_lanes_of_embeddings_on_a_stream(spark, tmp_path):
    """filter | split to 4 | window and embed in each lane | merge, from a source without numbers."""
    folder = tmp_path / "texts"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("".join(f"text {k} {i}\n" for i in range(8)))
    source = files.text_stream(spark, str(folder), 1)
    flow = Pipeline(source) | filter_pattern("text") | splitter(4) | window_count(3).with_slots(4) | embedder(embed.stub_client()).with_slots(4) | merger()
    found = streamed(flow, tmp_path, "lanes")
    # 24 messages in 4 lanes of 6, two windows of 3 in each.
    assert len(found) == 8 and all(len(batch) == 3 for batch in found)


def test_folds_on_a_stream(spark, stream, tmp_path):
    df, rows = stream(ITEMS)
    number = map_column(lambda p: F.length(p) * F.col("seq"), "value")
    for operation in ("sum", "count", "min", "max"):
        want = [r.payload for r in (Pipeline(rows) | number | reduce_running(operation)).dataframe().orderBy("seq").collect()]
        assert streamed(Pipeline(df) | number | reduce_running(operation), tmp_path, operation) == want


def test_the_callable_classes_on_a_stream(spark, stream, tmp_path):
    df, rows = stream(ITEMS)
    results = []
    for source in (df.withColumn("slot", F.lit(0)), rows.withColumn("slot", F.lit(0))):
        seen = []
        (callables.Source(source) | callables.Filter("m|^$") | callables.Window(500) | callables.Reduce(0, lambda n, ts: n + len(ts), "bigint") | callables.Collector(seen.append)).run()
        results.append(seen)
    assert results[0] == results[1] and results[1][-1] == len(ITEMS)


def test_sinks(spark, tmp_path):
    lines = []
    (Pipeline(fixtures.strings(spark)) | sinks.printer("> ", lines.append)).run()
    assert lines == ["> 0", "> 1", "> 2"]
    seen = []

    def callback(x):
        if x == "1":
            raise ValueError
        seen.append(x)

    (Pipeline(fixtures.strings(spark)) | sinks.collector(callback)).run()
    assert seen == ["0", "2"]
    (Pipeline(fixtures.strings(spark)) | sinks.parquet_folder(str(tmp_path / "out"))).run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counts = spark.createDataFrame([(0, "a", 20), (0, "b", 21)], "win int, word string, cnt int")
    assert [r.word for r in sinks.frequent_words(counts).collect()] == ["b"]


def test_monitor_reports_progress(spark, stream, tmp_path):
    df, _ = stream(ITEMS)
    lines = []
    watch = monitor.PipelineMonitor(spark, 0.1, lines.append)
    watch.register("watched")
    watch.start()
    watch.start()
    try:
        run(stateful.count_windows(df, 3), "watched", tmp_path)
        # Progress reports come some time after the batches that they are about.
        for _ in range(100):
            if lines and lines[-1]["total_rows"] == len(ITEMS) + 2:
                break
            time.sleep(0.1)
    finally:
        watch.stop()
    assert lines and {x["name"] for x in lines} == {"watched"}
    assert watch.snapshot()[0]["total_rows"] == len(ITEMS) + 2


class TestCallables:
    def source(self, spark):
        return callables.Source(fixtures.replay(spark, [("a", 100, None), ("b", 600, None), ("c", 1200, None), ("dd", 1300, None)]))

    def test_flow(self, spark):
        seen = []
        flow = self.source(spark) | callables.Filter("[a-z]") | callables.Window(1000) | callables.Reduce(0, lambda n, ts: n + len(ts), "bigint") | callables.Collector(seen.append)
        flow.run()
        assert seen == [3, 4]

    def test_errors_do_not_end_it(self, spark):
        def half(state, texts):
            if len(texts) == 1:
                raise ValueError
            return [*state, *texts]

        seen = []
        lam = callables.Filter.with_lambda(lambda t: {"a": True, "b": 1, "c": True}[t])
        flow = self.source(spark) | lam | callables.PipelineComponent(lambda t: t * 2 if t == "a" else None) | callables.Window(1000) | callables.Reduce(["s"], half, "array<string>") | callables.Collector(seen.append)
        flow.run()
        assert seen == [["s"]]
        seen.clear()

        def fails(texts):
            raise KeyError

        (self.source(spark) | callables.Window(1000) | callables.Map(fails) | callables.Collector(seen.append)).run()
        assert seen == [[], []]

    def test_what_a_reduce_gets_from_a_map(self, spark):
        seen = []
        count = callables.Reduce(0, lambda n, ts: n + len(ts), "bigint")
        (self.source(spark) | callables.Window(1000) | callables.Map(lambda ts: [t + "!" for t in ts]) | count | callables.Collector(seen.append)).run()
        assert seen == [3, 4]
        seen.clear()
        (self.source(spark) | callables.Window(1000) | callables.Map(lambda ts: len(ts), "int") | count | callables.Collector(seen.append)).run()
        assert seen == [0, 0]

    def test_matrix(self, spark):
        make = {
            "PipelineComponent": lambda: callables.PipelineComponent(str.upper),
            "Filter": lambda: callables.Filter("x"),
            "Window": lambda: callables.Window(10),
            "Map": lambda: callables.Map(list),
            "Reduce": lambda: callables.Reduce(0, lambda a, b: a, "int"),
            "Collector": lambda: callables.Collector(print),
        }
        lead = {
            "Source": [], "Filter": ["Filter"], "PipelineComponent": ["PipelineComponent"], "Window": ["Window"],
            "Map": ["Window", "Map"], "Reduce": ["Window", "Reduce"], "Collector": ["Window", "Map", "Collector"],
        }
        allowed = {
            "Source": {"PipelineComponent", "Filter", "Window"}, "Filter": {"PipelineComponent", "Filter", "Window"}, "PipelineComponent": {"PipelineComponent", "Filter", "Window"},
            "Window": {"Map", "Reduce"}, "Map": {"Reduce", "Collector"}, "Reduce": {"Collector"}, "Collector": set(),
        }
        for left, steps in lead.items():
            flow = self.source(spark)
            for s in steps:
                flow = flow | make[s]()
            for right, step in make.items():
                if right in allowed[left]:
                    assert flow | step()
                else:
                    with pytest.raises(TypeError):
                        flow | step()

    def test_bad_pattern(self):
        with pytest.raises(ValueError):
            callables.Filter("(")
