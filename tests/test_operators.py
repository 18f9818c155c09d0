"""Operators on small bounded sources: exact orders, metadata, and the awkward ends."""

import pytest
from pyspark.sql import functions as F

from sluice import message
from sluice.functions import regex, text
from sluice.operators import embed, filters, folds, lanes, maps, windows
from sluice.plans.pipeline import (
    Collected,
    Pipeline,
    Stage,
    collect_into,
    filter_pattern,
    filter_where,
    map_column,
    merger,
    reduce_function,
    reduce_running,
    splitter,
    transform,
    window_count,
    window_duration,
    window_sliding,
)
from sluice.sources import fixtures


def collected(pipeline):
    return list((pipeline | collect_into(Collected())).run())


def test_double(spark):
    assert collected(Pipeline(fixtures.numbers(spark), "value") | map_column(lambda x: x * 2)) == [0, 2, 4]


def test_source_only(spark):
    assert collected(Pipeline(fixtures.numbers(spark), "value")) == [0, 1, 2]


def test_double_twice(spark):
    twice = map_column(lambda x: x * 2)
    assert collected(Pipeline(fixtures.numbers(spark), "value") | twice | twice) == [0, 4, 8]


def test_round_robin(spark):
    assert collected(Pipeline(fixtures.numbers(spark), "value") | splitter(2)) == [0, 2, 1]


def test_filter_by_pattern(spark):
    assert collected(Pipeline(fixtures.strings(spark)) | filter_pattern("2")) == ["2"]


def test_filter_even_integers(spark):
    source = Pipeline(fixtures.strings(spark))
    assert collected(source | filter_where(text.is_even)) == ["0", "2"]


def test_even_integers_of_awkward_texts(spark):
    rows = spark.createDataFrame([(t,) for t in ["4", "-2", "+6", " 2", "2\n", "", "x", "3", "99999999999", None]], "payload string")
    assert [r[0] for r in filters.by_predicate(rows, text.is_even).collect()] == ["4", "-2", "+6"]


def test_prefix(spark):
    stage = map_column(lambda x: F.concat(F.lit("Number: "), x.cast("string")), "text")
    assert collected(Pipeline(fixtures.numbers(spark), "value") | stage) == ["Number: 0", "Number: 1", "Number: 2"]


def test_running_sum(spark):
    assert collected(Pipeline(fixtures.numbers(spark), "value") | reduce_running("sum", 0)) == [0, 1, 3]
    assert collected(Pipeline(fixtures.numbers(spark), "value") | reduce_function(lambda a, x: a + int(x), 0, "bigint")) == [0, 1, 3]


def test_count_window_joined(spark):
    stage = map_column(text.joined, "text")
    assert collected(Pipeline(fixtures.strings(spark)) | window_count(2) | stage) == ["0,1", "2"]


@pytest.mark.parametrize(
    ("items", "expected"),
    [
        ([("a", 100, None), ("b", 900, None), ("c", 1100, None), ("d", 5000, None), ("e", 5200, None), ("f", 6100, None)], [["a", "b", "c"], ["d"], ["e", "f"]]),
        ([("a", 400, None), ("b", 1000, None), ("c", 1500, None)], [["a", "b"], ["c"]]),
        ([], []),
    ],
)
def test_time_windows_replayed(spark, items, expected):
    source = fixtures.replay(spark, items) if items else fixtures.replay(spark, [("x", 0, 0)]).limit(0)
    assert [r.payload for r in windows.time_window(source, 1000).orderBy("win").collect()] == expected


@pytest.mark.parametrize(
    ("size", "slide", "items", "expected"),
    [
        (1000, 500, [("a", 100, None), ("b", 600, None), ("c", 1200, None)], [["a", "b"], ["b", "c"], ["b", "c"]]),
        (1000, 500, [("a", 100, None), ("b", 600, -900), ("c", 700, None)], [["a"], ["a", "c"]]),
        (100, 500, [("a", 600, 100), ("b", 700, None)], [["b"]]),
    ],
)
def test_sliding_windows_replayed(spark, size, slide, items, expected):
    made = windows.sliding_window(fixtures.replay(spark, items), size, slide)
    assert [r.payload for r in made.orderBy("win").collect()] == expected


def test_windows_by_slot_are_independent(spark):
    items = [(f"m{i}", i * 300, None) for i in range(12)]
    rows = fixtures.replay(spark, items).withColumn("slot", (F.col("seq") % 2).cast("int"))
    alone = {s: [r.payload for r in windows.time_window(rows.filter(F.col("slot") == s), 1000).orderBy("win").collect()] for s in (0, 1)}
    both = windows.time_window(rows, 1000).orderBy("slot", "win").collect()
    assert {s: [r.payload for r in both if r.slot == s] for s in (0, 1)} == alone
    sliding = windows.sliding_window(rows, 900, 600).orderBy("slot", "win").collect()
    for s in (0, 1):
        assert [r.payload for r in sliding if r.slot == s] == [r.payload for r in windows.sliding_window(rows.filter(F.col("slot") == s), 900, 600).orderBy("win").collect()]


def test_count_windows_end_and_threshold_zero(spark):
    wins = lambda n, k: [r.payload for r in windows.count_window(fixtures.strings(spark, n), k).orderBy("win").collect()]
    assert wins(4, 2) == [["0", "1"], ["2", "3"]]
    assert wins(3, 0) == [["0"], ["1"], ["2"]]
    assert wins(0, 2) == []


def test_window_stages_in_a_pipeline(spark):
    source = Pipeline(fixtures.replay(spark, [("a", 100, None), ("b", 600, None), ("c", 1200, None)]))
    assert collected(source | window_duration(1000)) == [["a", "b", "c"]]
    assert collected(source | window_sliding(1000, 500)) == [["a", "b"], ["b", "c"], ["b", "c"]]


def test_delays_add_up(spark):
    rows = fixtures.delayed(spark, [("a", 100), ("b", 0), ("c", 250)]).orderBy("seq").collect()
    assert [(r.payload, r.arrival_ms) for r in rows] == [("a", 100), ("b", 100), ("c", 350)]


def test_seq_is_the_order_whatever_the_partitions(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.col("id").alias("v"))
    made = message.with_seq(rows.repartition(9), "k", "v").orderBy("seq").collect()
    assert [r.seq for r in made] == list(range(5000)) and [r.k for r in made] == sorted(r.k for r in made)
    texts = spark.createDataFrame([("b",), ("é",), (None,), ("a",), ("b",)], "k string")
    assert [r.k for r in message.with_seq(texts, "k").orderBy("seq").collect()] == [None, "a", "b", "b", "é"]
    assert message.with_seq(texts.limit(0), "k").count() == 0


def test_metadata_is_kept_or_made_anew(spark):
    df = message.envelope(spark.createDataFrame([("x", "2020-01-02 03:04:05")], "t string, at string"), "t", ("t",), event_ts=F.col("at").cast("timestamp"), source_id="s")
    old = df.select("event_ts", "ingest_ts", "source_id").first()
    for kept in (filters.by_pattern(df, "x"), maps.by_column(df, F.upper), lanes.merge(df)):
        assert kept.first().event_ts == old.event_ts and kept.first().source_id == "s"
    for anew in (message.reset(df), folds.running(df, "count")):
        assert anew.first().event_ts != old.event_ts and anew.first().source_id is None
    assert message.sent(df, None).first().source_id == "s" and message.sent(df, "t").first().source_id == "t"


def test_running_folds_across_chunks(spark):
    rows = fixtures.numbers(spark, 100)
    for operation, expected in (("sum", [sum(range(i + 1)) for i in range(100)]), ("count", list(range(1, 101))), ("min", [0] * 100), ("max", list(range(100)))):
        assert [r.payload for r in folds.running(rows, operation, chunk=7).orderBy("seq").collect()] == expected
    assert folds.running(rows.limit(0), "sum").count() == 0
    assert folds.final(rows.limit(0), "max", initial=5).first().payload == 5
    assert folds.final_by(rows, lambda a, x: a * 2 + int(x) % 2, 0, "decimal(38,0)").count() == 1


def test_fold_snapshots_and_errors(spark):
    def step(state, x):
        if x == 1:
            raise ValueError
        state.append(int(x))
        return state

    rows = folds.running_by(fixtures.numbers(spark), step, [], "array<bigint>", keep_on_error=True)
    assert [r.payload for r in rows.orderBy("seq").collect()] == [[0], [0], [0, 2]]


def test_counts_go_on_over_windows(spark):
    batches = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b"]), (2, ["a"])], "win bigint, payload array<string>")
    per = folds.counts_per_window(batches)
    assert {(r.win, r.word): r.cnt for r in per.collect()} == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 1, (2, "a"): 1}
    assert {(r.win, r.word): r.cnt for r in folds.counts_so_far(per).collect()} == {(0, "a"): 2, (1, "a"): 2, (2, "a"): 3, (0, "b"): 1, (1, "b"): 2, (2, "b"): 2}


def test_combine_and_slots(spark):
    a, b = Pipeline(fixtures.strings(spark)), Pipeline(fixtures.strings(spark, 2))
    assert sorted(collected(a.combine(b).combine(b))) == ["0", "0", "0", "1", "1", "1", "2"]
    with pytest.raises(TypeError):
        (a | filter_pattern("x")).combine(b)
    with pytest.raises(TypeError):
        a.combine(Pipeline(fixtures.numbers(spark), "value"))
    # One lane feeds lane 0 alone; a splitter deals; the merger brings lanes together.
    one = Pipeline(fixtures.numbers(spark, 8), "value")
    assert {r.slot for r in (one | window_count(2).with_slots(4)).dataframe().collect()} == {0}
    assert {r.slot for r in (one | splitter(4) | window_count(2).with_slots(4)).dataframe().collect()} == {0, 1, 2, 3}
    assert {r.slot for r in (one | splitter(4) | window_count(2).with_slots(4) | merger()).dataframe().collect()} == {0}


def test_what_cannot_be_composed(spark):
    source = Pipeline(fixtures.strings(spark))
    with pytest.raises(TypeError):
        source | "no stage"
    with pytest.raises(TypeError):
        source | collect_into(Collected()) | filter_pattern("x")
    with pytest.raises(TypeError):
        Pipeline(fixtures.numbers(spark), "value") | filter_pattern("1")
    for bad in (lambda: splitter(1), lambda: Stage("s", lambda df, _: df, slots=0), lambda: window_count(2).with_slots(0), lambda: lanes.split_round_robin(fixtures.numbers(spark), 1)):
        with pytest.raises(ValueError):
            bad()


def test_own_stage(spark):
    twice = transform(lambda df: df.unionByName(df), gives="text")
    assert sorted(collected(Pipeline(fixtures.strings(spark)) | twice)) == ["0", "0", "1", "1", "2", "2"]


@pytest.mark.parametrize(
    ("pattern", "value", "found"),
    [
        ("2", "123", True),
        (r"^\w+$", "é", True),
        (r"^\d+$", "٣", True),
        ("^a$", "a\n", False),
        ("^a$", "a", True),
        ("(?m)^a$", "b\na\nc", True),
        ("a.b", "a b", True),
        ("a.b", "a\nb", False),
        (r"\$", "cost $5", True),
        ("[$]$", "5$", True),
        ("(?P<x>a)b", "ab", True),
        (".*", "", True),
    ],
)
def test_pattern_dialect(spark, pattern, value, found):
    rows = spark.createDataFrame([(value,)], "payload string")
    assert bool(filters.by_pattern(rows, pattern).count()) is found


@pytest.mark.parametrize("pattern", ["(", "a(?=b)", "a(?<!b)", r"(a)\1", "a++", "[", "*a", "(?>a)"])
def test_bad_patterns_raise_when_given(spark, pattern):
    with pytest.raises(regex.PatternError):
        filter_pattern(pattern)


def test_strip_html_and_words(spark):
    rows = spark.createDataFrame([(" <p class='x'>Hello<br>  <b>w</b>&amp;</p>\n",)], "h string")
    assert rows.select(text.strip_html(F.col("h"))).first()[0] == "Hello w &amp;"
    rows = spark.createDataFrame([(" a b c d ",)], "t string")
    assert rows.select(text.words(F.col("t"))).first()[0] == ["a", "b", "c", "d"]


def test_embeddings(spark):
    batches = windows.count_window(fixtures.strings(spark), 2).withColumn("seq", F.col("win"))

    def client(texts):
        if texts == ["2"]:
            raise TimeoutError
        return [[float(t), 0.5] for t in texts]

    made = embed.embed_batches(batches, client)
    assert [r.payload for r in made.collect()] == [[[0.0, 0.5], [1.0, 0.5]]]
    assert [(r.n_vectors, r.place, r.dimension, r.head) for r in embed.preview(made, 1).collect()] == [(2, 1, 2, [0.0]), (2, 2, 2, [1.0])]
    assert sorted(r.payload for r in embed.embed_texts(fixtures.strings(spark), client).collect()) == [[0.0, 0.5], [1.0, 0.5]]
    assert embed.parse_batch_reply('{"embeddings": [{"values": [1, "x", 2.5]}]}') == [[1.0, 0.0, 2.5]]
    assert embed.parse_flat_reply("[1, null]") == [1.0, 0.0]
    for bad in ('{"error": "busy"}', "no json"):
        with pytest.raises((KeyError, ValueError)):
            embed.parse_batch_reply(bad)
    with pytest.raises(KeyError):
        embed.BatchHttpClient("http://localhost", key_variable="NO_SUCH_KEY")


def test_functions_get_integers_beside_nulls(spark):
    from sluice.operators import maps

    rows = spark.createDataFrame([(1,), (None,), ((1 << 60) + 1,)], "payload bigint")
    assert [r.payload for r in maps.by_callable(rows.coalesce(1), lambda v: repr(v), "string").collect()] == ["1", "None", str((1 << 60) + 1)]


def test_order_of_a_table_with_one_hot_key(spark):
    from sluice.message import with_seq

    rows = spark.range(3000).selectExpr("if(id % 3 < 2, 7, id) as k", "id", "map('a', id) as m")
    out = with_seq(rows, "k", "id").orderBy("seq").collect()
    assert [(r.k, r.id) for r in out] == sorted((r.k, r.id) for r in out) and [r.seq for r in out] == list(range(3000))
