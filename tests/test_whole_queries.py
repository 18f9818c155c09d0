"""Queries that keep every row of their job, on small tables."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice import message, queries
from sluice.operators import embed, folds, windows
from sluice.plans.pipeline import Kept, Pipeline, collect_into, splitter
from sluice.sources import firehose, fixtures
from sluice.streaming import sinks


def events(spark, path, n):
    """``n`` events in ten files that are out of order."""
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.concat(F.lit("type"), F.col("id") % 3).alias("event_type"))
    rows.repartition(10, F.col("event_id") % 7).write.parquet(f"{path}/events.parquet")


@pytest.fixture
def driver_rows(spark, monkeypatch):
    """How many rows each call has brought to the driver."""
    counts, kind = [], type(spark.range(0))
    collect, local = kind.collect, kind.toLocalIterator

    def collected(df):
        found = collect(df)
        counts.append(len(found))
        return found

    def iterated(df, *args):
        counts.append(0)
        for row in local(df, *args):
            counts[-1] += 1
            yield row

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(kind, "toLocalIterator", iterated)
    monkeypatch.setattr(message, "BOUND_SAMPLE", 100)
    return counts


def test_cumulative_counts_hold_every_word(spark, tmp_path):
    texts = [f"often once{i} " + ("rare " if i == 3 else "") + "often" for i in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["window_word_count_cumulative"](spark, str(tmp_path)).collect()
    so_far, want = Counter(), {}
    for win in range(3):
        so_far.update(w for t in texts[50 * win : 50 * win + 50] for w in re.split(r"\s+", t) if w)
        want |= {(win, w): n for w, n in so_far.items()}
    assert {(r.win, r.word): r.cnt for r in got} == want and len(got) == len(want)


def test_cumulative_counts_leave_out_windows_without_words(spark, tmp_path, monkeypatch):
    texts = [f"a w{i % 40}" if i // 50 in (1, 3, 9) else (None, "", " \n")[i % 3] for i in range(620)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet') FROM ({queries.ORACLES['window_word_count_cumulative']})").fetchall()
    assert {row[0] for row in want} == {1, 3, 9}
    for block in (1, 8, folds.BLOCK):
        monkeypatch.setattr(folds, "BLOCK", block)
        got = queries.QUERIES["window_word_count_cumulative"](spark, str(tmp_path)).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_cumulative_counts_move_texts_once(spark, tmp_path, monkeypatch):
    texts = [f"often {'filler ' * 150}w{i % 3}" for i in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(message, "PART_BYTES", 1 << 15)
    made = queries.QUERIES["window_word_count_cumulative"](spark, str(tmp_path))
    want = [(win, word, n * (win + 1)) for win in range(12) for word, n in (("often", 50), ("filler", 7500))]
    assert [r for r in sorted((r.win, r.word, r.cnt) for r in made.collect()) if r[1][0] != "w"] == sorted(want)
    final = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = re.findall(r"^(?!.*Reused).*Exchange \w+\((?:\w+\()?(\w+)#.*REPARTITION", final, re.M)
    assert sorted(dealt) == ["__part", "word"]


def test_cumulative_counts_are_written_small(spark, tmp_path, monkeypatch):
    texts = [f"often w{i * 7919 % 1500} {i}" for i in range(1500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "DOCS_PER_WINDOW", 1)
    queries.QUERIES["window_word_count_cumulative"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == 1500 + 1500 * 1501
    assert rows.filter("word = 'often' and cnt <> win + 1 or word <> 'often' and cnt <> 1").count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * rows.count()


def test_collected_without_the_driver(spark, tmp_path, driver_rows):
    events(spark, tmp_path, 3000)
    made = queries.QUERIES["sink_collected"](spark, str(tmp_path))
    assert max(driver_rows) <= 200
    assert sorted(tuple(r) for r in made.collect()) == [(i, f"type{i % 3}") for i in range(3000)]


def test_kept_batches_and_slots_in_order(spark, tmp_path):
    found = Kept(f"{tmp_path}/kept")
    for n in (3, 2):
        (Pipeline(fixtures.strings(spark, n)) | splitter(2) | collect_into(found)).run()
    assert sorted(tuple(r) for r in found.dataframe(spark).collect()) == [(0, "0"), (1, "2"), (2, "1"), (3, "0"), (4, "1")]


def test_called_back_without_the_driver(spark, tmp_path, driver_rows):
    events(spark, tmp_path, 5000)
    made = queries.QUERIES["sink_callback"](spark, str(tmp_path))
    assert max(driver_rows) <= 200
    want = [str(i) for i in range(5000) if i % 2000]
    assert sorted(tuple(r) for r in made.collect()) == list(enumerate(want))


def test_printed_without_the_driver(spark, tmp_path, driver_rows):
    events(spark, tmp_path, 3000)
    made = queries.QUERIES["sink_printer"](spark, str(tmp_path))
    assert max(driver_rows) <= 200
    assert sorted(tuple(r) for r in made.collect()) == [(i, f"> type{i % 3}") for i in range(3000)]


def test_nothing_is_printed_as_by_python(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a"), (1, None)], "seq bigint, payload string")
    lines, kept = [], Kept(f"{tmp_path}/kept")
    (Pipeline(rows) | sinks.printer("> ", lines.append)).run()
    (Pipeline(rows) | sinks.printer("> ", kept)).run()
    assert [r.payload for r in kept.dataframe(spark).orderBy("place").collect()] == lines


def python_steps(df):
    """The kinds of steps of a plan that run Python: BatchEvalPython gets rows by the hundred, others by the ten thousand."""
    return set(re.findall(r"\b\w*(?:Python|Pandas|Arrow)\w*\b(?= )", df._jdf.queryExecution().executedPlan().toString())) - {"InPandas"}


def test_frames_go_to_python_by_the_hundred(spark, tmp_path):
    rows = [(i, f"text {i} é") for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.QUERIES["firehose_parse"](spark, str(tmp_path))
    assert python_steps(made) == {"BatchEvalPython"}
    assert sorted(r.payload for r in made.collect()) == sorted(t for i, t in rows if i % 3 and i % 7 and i % 11 and i % 13)
    mixed = spark.createDataFrame([(None,), (bytearray(b"\x01"),)], "frame binary")
    assert firehose.posts(mixed).collect() == []


def test_windows_of_long_texts_are_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = [f"often {'filler ' * 150}w{i % 3}" for i in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(message, "PART_BYTES", 1 << 15, raising=False)
    made = queries.QUERIES["window_word_count"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 600 * 1000 >> 15
    want = {(win, word): n for win in range(12) for word, n in Counter(w for t in texts[50 * win : 50 * win + 50] for w in t.split()).items() if n > 20}
    assert {(r.win, r.word): r.cnt for r in made.collect()} == want


def test_order_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(message, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(message, "BOUND_SAMPLE", 50)
    rows = spark.range(500).selectExpr("if(id % 5 = 0, null, id * 7 % 500) as k", "id", "array(id, id) as a", "map('x', named_struct('y', id)) as m", "cast(cast(id as string) as binary) as b")
    out = message.with_seq(rows, "k", "id").orderBy("seq").collect()
    nulls_first = lambda r: (r.k is not None, r.k or 0, r.id)
    assert [r.id for r in out] == [r.id for r in sorted(out, key=nulls_first)] and [r.seq for r in out] == list(range(500))
    assert message.ranges(rows, "k").tasks > message.FEW_TASKS
    assert message.ranges(rows.filter("k is null"), "k") == message.Ranges([], 0)


def test_a_task_numbers_one_range(spark, monkeypatch):
    monkeypatch.setattr(message, "PART_BYTES", 1 << 10)
    rows = message.with_seq(spark.range(2000), "id")
    by_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > message.FEW_TASKS and sum(by_task) == 2000 and max(by_task) < 1.2 * 2000 / len(by_task)


def test_one_slot_is_numbered_by_many_tasks(spark):
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(off, "false")
    try:
        rows = windows.with_count_window(fixtures.strings(spark, 40_000), 10)
        by_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(off)
    assert sum(by_task) == 40_000 and max(by_task) < 20_000
    assert rows.filter("win <> cast(payload as bigint) div 10").count() == 0


def test_batches_to_embed_go_to_python_by_the_hundred(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(texts):
        calls.add(1)
        return [[int(t), None] for t in texts]

    made = embed.embed_batches(windows.count_window(fixtures.strings(spark), 2), client)
    assert python_steps(made) == {"BatchEvalPython"}
    assert sorted(r.payload for r in made.collect()) == [[[0.0, None], [1.0, None]], [[2.0, None]]]
    assert calls.value == 2
