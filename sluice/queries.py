"""Registered queries of the engine's own operators, each with its DuckDB twin.

``QUERIES[name](spark, sf_dir)`` gives a DataFrame; ``ORACLES[name]`` is SQL over the same tables with
equal column names. Where order is the point, a seq or win column carries it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as text_functions
from .message import envelope, millis, ranges, with_seq
from .operators import embed, filters, folds, lanes, maps, windows
from .plans import callables
from .plans.pipeline import Collected, Kept, Pipeline, collect_into, embedder, filter_pattern, map_column, merger, reduce_each, reduce_running, splitter, window_count
from .session import shared_path
from .sources import files, firehose, fixtures, microblog
from .streaming.sinks import collector, frequent_words, printer

DAY_MS = 86_400_000
START_MS = 1_704_067_200_000  # 2024-01-01, where the events begin
DOCS_PER_WINDOW = 50
#: Tasks that words are dealt to for each that texts are: their distinct words then fit the 1 MB of a Parquet dictionary.
WORD_TASKS = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark: SparkSession, sf_dir: str, name: str, payload: Column | str, *order: str, event_ts: str | None = None) -> DataFrame:
    return envelope(_table(spark, sf_dir, name), payload, order, event_ts=event_ts, ingest_ts=event_ts)


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrived, with event times that lag behind by 0 to 4 hours."""
    rows = _messages(spark, sf_dir, "events", "event_id", "event_id", event_ts="ts")
    arrival = millis("event_ts")
    return rows.select("slot", "seq", "payload", arrival.alias("arrival_ms"), (arrival - F.pmod(F.col("payload") * 7919, F.lit(5)) * 3_600_000).alias("event_ms"))


def _doc_windows(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """(win, payload): the documents' words, a window number for every 50 documents.

    With ``together`` a window's texts come to one task, which then counts its words without sending them on.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = ranges(docs, "doc_id")
    made = windows.dense_count_window(envelope(docs, "text", ("doc_id",), dealt=dealt), DOCS_PER_WINDOW).select("win", "payload")
    if together and dealt.tasks:
        made = made.repartition(dealt.tasks, "win")
    return made.select("win", text_functions.words(F.col("payload")).alias("payload"), F.char_length("payload").alias("chars"))


@query("SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, 'tion[a-z]* (the|and|of)[ ,.]')")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_pattern(_table(spark, sf_dir, "documents"), "tion[a-z]* (the|and|of)[ ,.]", "text").select("doc_id", "n_chars")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07")
def filter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (F.col("l_quantity") < 24) & F.col("l_discount").between(0.05, 0.07)
    return filters.by_predicate(_table(spark, sf_dir, "lineitem"), where).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT event_id, props AS payload FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AND event_id % 5 <> 0")
def filter_udf_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python predicate; on every fifth row it raises, which counts as no."""

    def even(props: str) -> bool:
        import json

        return json.loads(props)["k"] % 2 == 0

    broken = F.when(F.col("event_id") % 5 == 0, F.lit("no json")).otherwise(F.col("props"))
    return filters.by_callable(_table(spark, sf_dir, "events").select("event_id", broken.alias("payload")), even)


@query("SELECT event_id FROM events WHERE CASE WHEN regexp_matches(CAST(user_id AS VARCHAR), '^[0-9]+$') THEN user_id % 2 = 0 ELSE false END AND event_id % 5 <> 0")
def filter_even_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are even integers; on every fifth row the text is none."""
    mixed = F.when(F.col("event_id") % 5 == 0, F.lit("x2")).otherwise(F.col("user_id").cast("string"))
    return filters.by_predicate(_table(spark, sf_dir, "events").select("event_id", mixed.alias("payload")), text_functions.is_even).select("event_id")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, value * 2 AS payload FROM events")
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.doubled(_messages(spark, sf_dir, "events", "value", "event_id")).select("seq", "payload")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, 'Number: ' || event_id AS payload FROM events")
def map_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir, "events", "event_id", "event_id")
    return maps.by_column(rows, lambda x: F.concat(F.lit("Number: "), x.cast("string"))).select("seq", "payload")


@query("SELECT event_id, upper(event_type) || '-' || event_id AS payload FROM events WHERE event_id % 3 <> 0")
def flatmap_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that gives text, nothing, or raises; only text goes on."""

    def component(text: str) -> str | None:
        kind, number = text.split(":")
        return [None, f"{kind.upper()}-{number}", f"{kind.upper()}-{number}"][int(number) % 3]

    rows = envelope(_table(spark, sf_dir, "events"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")), ("event_id",))
    made = maps.text_or_nothing(rows, component)
    return made.select(F.substring_index("payload", "-", -1).cast("bigint").alias("event_id"), "payload")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS payload FROM pages")
def map_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text_functions.strip_html(F.col("html")).alias("payload"))


@query(r"""
SELECT doc_id, CAST(i AS BIGINT) AS place, ws[i] AS word
FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i
      FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents))
""")
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text_functions.words(F.col("text"))).alias("place", "word"))
    return rows.select("doc_id", (F.col("place") + 1).cast("bigint").alias("place"), "word")


_RUNNING = "SELECT row_number() OVER o - 1 AS seq, {} AS payload FROM events WINDOW o AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query(_RUNNING.format("CAST(sum(user_id) OVER o AS BIGINT)"))
def reduce_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.running(_messages(spark, sf_dir, "events", "user_id", "event_id"), "sum", initial=0).select("seq", "payload")


@query(_RUNNING.format("CAST(count(props) OVER o AS BIGINT)"))
def reduce_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.running(_messages(spark, sf_dir, "events", "props", "event_id"), "count").select("seq", "payload")


@query(_RUNNING.format("max(value) OVER o"))
def reduce_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.running(_messages(spark, sf_dir, "events", "value", "event_id"), "max").select("seq", "payload")


@query("""
WITH numbered AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events),
runs AS (SELECT *, sum(CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS run FROM numbered)
SELECT seq, CAST(sum(CASE WHEN user_id % 7 = 0 THEN 0 ELSE user_id END) OVER (PARTITION BY run ORDER BY seq) AS BIGINT) AS payload FROM runs
""")
def reduce_custom_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that no associative operation gives: a sum that starts anew at multiples of 7."""

    def step(state: int, user: int) -> int:
        return 0 if user % 7 == 0 else state + int(user)

    return folds.running_by(_messages(spark, sf_dir, "events", "user_id", "event_id"), step, 0, "bigint")


@query("SELECT CAST(sum(user_id) AS BIGINT) + 5 AS payload FROM events")
def reduce_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.final(_table(spark, sf_dir, "events"), "sum", "user_id", initial=5)


@query("SELECT CAST(7 AS BIGINT) AS payload")
def reduce_final_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without messages the last state is the initial one."""
    return folds.final(_table(spark, sf_dir, "events").filter("event_id < 0"), "sum", "user_id", initial=F.lit(7).cast("bigint"))


@query("""
SELECT rn // 100 AS win, count(*) AS n, string_agg(event_type, ',' ORDER BY rn) AS payload
FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 1
""")
def window_count_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.count_window(_messages(spark, sf_dir, "events", "event_type", "event_id"), 100)
    return made.select("win", F.size("payload").cast("bigint").alias("n"), text_functions.joined(F.col("payload")).alias("payload"))


@query("""
SELECT CAST(rn % 4 AS INTEGER) AS slot, (rn // 4) // 25 AS win, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS payload
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 1, 2
""")
def window_count_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes.split_round_robin(_messages(spark, sf_dir, "events", "event_id", "event_id"), 4)
    return windows.count_window(rows, 25).select("slot", "win", text_functions.joined(F.col("payload")).alias("payload"))


_ARRIVALS = f"""
WITH RECURSIVE e AS (
    SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq, epoch_ms(ts) AS came,
           epoch_ms(ts) - (event_id * 7919 % 5) * 3600000 AS ev FROM events
), t AS (
    SELECT CAST(0 AS BIGINT) AS win, CAST({START_MS} AS BIGINT) AS came, CAST(-1 AS BIGINT) AS q
    UNION ALL
    SELECT t.win + 1, n.came, n.seq FROM t, LATERAL (SELECT e.came, e.seq FROM e WHERE e.seq > t.q AND e.came >= t.came + {DAY_MS} ORDER BY e.seq LIMIT 1) n
)"""


@query(_ARRIVALS + """
SELECT w.win, count(*) AS n, min(e.event_id) AS first_id, max(e.event_id) AS last_id
FROM (SELECT win, q + 1 AS lo, coalesce(lead(q) OVER (ORDER BY win), 9223372036854775807) AS hi FROM t) w JOIN e ON e.seq BETWEEN w.lo AND w.hi GROUP BY 1
""")
def window_time_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.time_window(_replayed(spark, sf_dir), DAY_MS, START_MS)
    return made.select("win", F.size("payload").cast("bigint").alias("n"), F.array_min("payload").alias("first_id"), F.array_max("payload").alias("last_id"))


@query(_ARRIVALS + f""", fired AS (
    SELECT win - 1 AS win, came, q FROM t WHERE win > 0
), last AS (
    SELECT max(q) AS q, max(came) - {2 * DAY_MS} AS cutoff FROM fired
), members AS (
    SELECT f.win, e.event_id FROM fired f JOIN e ON e.seq <= f.q AND e.ev >= greatest(0, f.came - {2 * DAY_MS})
    UNION ALL
    SELECT (SELECT max(win) + 1 FROM fired), e.event_id FROM e, last WHERE e.seq > last.q OR e.ev >= last.cutoff
)
SELECT win, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM members GROUP BY 1
""")
def window_sliding_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.sliding_window(_replayed(spark, sf_dir), 2 * DAY_MS, DAY_MS, START_MS)
    return made.select("win", F.size("payload").cast("bigint").alias("n"), F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("ids"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def window_time_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_id").alias("payload"))
    return _counted(windows.event_tumbling(rows, "1 day", aggregates=(F.count("*").alias("n"), F.sum("payload").alias("ids"))))


@query(f"""
SELECT s AS start_ms, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM (SELECT event_id, unnest([epoch_ms(ts) // {DAY_MS} * {DAY_MS}, epoch_ms(ts) // {DAY_MS} * {DAY_MS} - {DAY_MS}]) AS s FROM events) GROUP BY 1
""")
def window_sliding_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_id").alias("payload"))
    return _counted(windows.event_sliding(rows, "2 days", "1 day", aggregates=(F.count("*").alias("n"), F.sum("payload").alias("ids"))))


def _counted(made: DataFrame) -> DataFrame:
    return made.select(millis(F.col("window.start")).alias("start_ms"), "n", "ids")


_WORDS = rf"""
WITH w AS (
    SELECT (row_number() OVER (ORDER BY doc_id) - 1) // {DOCS_PER_WINDOW} AS win, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws, length(text) AS chars FROM documents
), counts AS (
    SELECT win, word, count(*) AS cnt FROM (SELECT win, unnest(ws) AS word FROM w) GROUP BY 1, 2
)"""


@query(_WORDS + " SELECT win, word, cnt FROM counts WHERE cnt > 20")
def window_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a window of 50 documents holds more than 20 times."""
    return frequent_words(folds.counts_per_window(_doc_windows(spark, sf_dir, together=True)), 20)


@query(_WORDS + """, grid AS (
    SELECT wins.win, words.word FROM (SELECT DISTINCT win FROM counts) wins, (SELECT word, min(win) AS first FROM counts GROUP BY word) words WHERE wins.win >= words.first
)
SELECT g.win, g.word, CAST(sum(coalesce(c.cnt, 0)) OVER (PARTITION BY g.word ORDER BY g.win) AS BIGINT) AS cnt
FROM grid g LEFT JOIN counts c ON c.win = g.win AND c.word = g.word
""")
def window_word_count_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that go on over windows, for every word.

    Texts are moved once, to be numbered, and counted where they then lie; a window that two tasks
    share is summed where the words' counts meet.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = ranges(docs, "doc_id")
    rows = windows.dense_count_window(with_seq(docs, "doc_id", dealt=dealt, within="part"), DOCS_PER_WINDOW)
    counts = folds.counts_per_window(rows.select("win", "part", text_functions.words(F.col("text")).alias("payload")), "part")
    held = rows.filter(text_functions.holds_words(F.col("text"))).select("win")
    return folds.counts_so_far(counts, held, WORD_TASKS * dealt.tasks)


@query(_WORDS + """
SELECT win, count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS total_words, CAST(sum(chars) AS BIGINT) AS total_chars,
       round(sum(len(ws)) / count(*), 2) AS avg_words, round(sum(chars) / count(*), 2) AS avg_chars FROM w GROUP BY 1
""")
def window_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_windows(spark, sf_dir).select("win", F.size("payload").alias("words"), "chars")
    total = {"total_words": F.sum("words"), "total_chars": F.sum("chars")}
    made = rows.groupBy("win").agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in total.items()])
    return made.select("*", F.round(F.col("total_words") / F.col("n"), 2).alias("avg_words"), F.round(F.col("total_chars") / F.col("n"), 2).alias("avg_chars"))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS INTEGER) AS slot FROM orders")
def split_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes.split_round_robin(_messages(spark, sf_dir, "orders", "o_orderkey", "o_orderkey"), 4)
    return rows.select(F.col("payload").alias("o_orderkey"), "slot")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_orderkey, CAST(0 AS INTEGER) AS slot FROM orders")
def merge_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes.merge(lanes.split_round_robin(_messages(spark, sf_dir, "orders", "o_orderkey", "o_orderkey"), 4))
    return rows.select("seq", F.col("payload").alias("o_orderkey"), "slot")


@query("SELECT CAST(i % 3 AS INTEGER) AS slot, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS i FROM orders) GROUP BY 1")
def slots_to_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lanes into three, without a splitter: lane i feeds lane i modulo 3."""
    rows = lanes.split_round_robin(_messages(spark, sf_dir, "orders", "o_orderkey", "o_orderkey"), 5)
    return lanes.between_stages(rows, 5, 3).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("payload").alias("keys"))


@query("SELECT 'documents' AS source_id, text AS payload FROM documents UNION ALL SELECT 'conversations', text FROM conversations")
def combine_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _messages(spark, sf_dir, "documents", "text", "doc_id")
    talk = _messages(spark, sf_dir, "conversations", "text", "conv_id", "turn")
    return lanes.combine(docs, talk, source_ids=["documents", "conversations"]).select("source_id", "payload")


@query("""
SELECT rn // 10 AS seq, count(*) OVER (PARTITION BY rn // 10) AS n_vectors, rn % 10 + 1 AS place, CAST(8 AS BIGINT) AS dimension,
       (CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) - 128) / 128.0::DOUBLE AS v1, (CAST('0x' || substr(sha256(text), 9, 2) AS INTEGER) - 128) / 128.0::DOUBLE AS v5
FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)
""")
def embed_batch_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.count_window(_messages(spark, sf_dir, "documents", "text", "doc_id"), 10).withColumn("seq", F.col("win"))
    return _previewed(embed.preview(embed.embed_batches(made, embed.stub_client())))


def _previewed(rows: DataFrame) -> DataFrame:
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select("seq", long("n_vectors"), long("place"), long("dimension"), F.get("head", F.lit(0)).cast("double").alias("v1"), F.get("head", F.lit(4)).cast("double").alias("v5"))


@query("""
SELECT doc_id, CAST(8 AS BIGINT) AS dimension, (CAST('0x' || substr(sha256(text), 3, 2) AS INTEGER) - 128) / 128.0::DOUBLE AS v2 FROM documents WHERE doc_id % 3 <> 0
""")
def embed_text_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call a text; where the client fails the text is dropped."""
    stub = embed.stub_client()

    def client(texts: list[str]) -> list[list[float]]:
        number, _, text = texts[0].partition(":")
        if int(number) % 3 == 0:
            raise ConnectionError("no answer")
        return [[*v, float(number)] for v in stub([text])]

    rows = _table(spark, sf_dir, "documents").select(F.concat_ws(":", F.col("doc_id").cast("string"), "text").alias("payload"))
    made = embed.embed_texts(rows, client)
    return made.select(F.get("payload", F.lit(8)).cast("bigint").alias("doc_id"), (F.size("payload") - 1).cast("bigint").alias("dimension"), F.get("payload", F.lit(1)).cast("double").alias("v2"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dimension, CAST(embedding[1] AS DOUBLE) AS v1, CAST(embedding[5] AS DOUBLE) AS v5 FROM embeddings")
def vector_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.array("embedding").alias("payload"))
    return _previewed(embed.preview(rows)).select(F.col("seq").alias("vec_id"), "dimension", "v1", "v5")


def _created_at() -> Column:
    return F.date_format(F.timestamp_millis(F.lit(START_MS) + F.col("doc_id") * 1001), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_CREATED = f"{START_MS} + doc_id * 1001"


@query(f"SELECT text AS payload, {_CREATED} AS event_ms FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def microblog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with deletions, broken JSON and bad times between the posts."""
    at = F.when(F.col("doc_id") % 7 == 0, F.lit("yesterday")).otherwise(_created_at())
    inner = F.to_json(F.struct(F.col("text").alias("content"), at.alias("created_at")))
    event = F.when(F.col("doc_id") % 3 == 0, F.lit("delete")).otherwise(F.lit("update"))
    frame = F.when(F.col("doc_id") % 11 == 0, F.lit('{"event": "update", "payload": ')).otherwise(F.to_json(F.struct(event.alias("event"), inner.alias("payload"))))
    made = microblog.posts(_table(spark, sf_dir, "documents").select(frame.alias("value")))
    return made.select("payload", millis("event_ts").alias("event_ms"))


@query(f"SELECT text AS payload, {_CREATED} AS event_ms FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0")
def firehose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary frames with other actions, other types, bad times and cut frames between the posts."""

    def framed(n: int, t: str, a: str) -> bytes:
        kind = firehose.POST if n % 11 else "app.bsky.feed.like"
        made = firehose.frame(t, a if n % 7 else "yesterday", "create" if n % 3 else "delete", kind)
        return made if n % 13 else made[:-5]

    framed = F.udf(framed, "binary", useArrow=False)
    frames = _table(spark, sf_dir, "documents").select(framed("doc_id", "text", _created_at()).alias("frame"))
    return firehose.posts(frames).select("payload", millis("event_ts").alias("event_ms"))


@query(r"""
WITH p AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS rn, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT ((rn // 4) // 5) * 4 + rn % 4 AS seq, count(*) OVER (PARTITION BY (rn // 4) // 5, rn % 4) AS n_vectors, (rn // 4) % 5 + 1 AS place, CAST(8 AS BIGINT) AS dimension,
       (CAST('0x' || substr(sha256(t), 1, 2) AS INTEGER) - 128) / 128.0::DOUBLE AS v1, (CAST('0x' || substr(sha256(t), 9, 2) AS INTEGER) - 128) / 128.0::DOUBLE AS v5
FROM p
""")
def pipeline_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strip | split to 4 | window of 5 in each lane | embed in each lane | merge."""
    source = Pipeline(_messages(spark, sf_dir, "pages", "html", "page_id"))
    flow = source | map_column(text_functions.strip_html, "text") | splitter(4) | window_count(5).with_slots(4) | embedder(embed.stub_client()).with_slots(4) | merger()
    return _previewed(embed.preview(flow.dataframe()))


@query(_ARRIVALS + """, kept AS (
    SELECT w.win, e.seq, ev.event_type FROM (SELECT win, q + 1 AS lo, coalesce(lead(q) OVER (ORDER BY win), 9223372036854775807) AS hi FROM t) w
    JOIN e ON e.seq BETWEEN w.lo AND w.hi JOIN events ev ON ev.event_id = e.event_id
)
SELECT win AS seq, CAST(sum(count(*)) OVER (ORDER BY win) AS BIGINT) AS payload FROM kept GROUP BY win
""")
def callable_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source | filter | window | reduce of Python functions: how many messages came so far, a window at a time."""
    rows = _messages(spark, sf_dir, "events", "event_type", "event_id", event_ts="ts")
    flow = callables.Source(rows) | callables.Filter("[a-z]") | callables.Window(DAY_MS, START_MS) | callables.Reduce(0, lambda n, texts: n + len(texts), "bigint")
    return flow.pipeline.dataframe().select("seq", "payload")


@query("SELECT doc_id, text AS payload FROM documents WHERE text IS NOT NULL")
def filter_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter without a pattern keeps all messages."""
    rows = _table(spark, sf_dir, "documents").filter("text is not null")
    return filters.everything(rows.select("doc_id", F.col("text").alias("payload"))).select("doc_id", "payload")


_LINES = "SELECT CAST(i - 1 AS BIGINT) AS place, ls[i] AS payload FROM (SELECT ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT list(line ORDER BY event_id) AS ls FROM (SELECT event_id, event_type || ' ' || event_id AS line FROM events)))"


@query(_LINES)
def file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a text file, written from the events, in the order of the file."""
    path = shared_path(spark, "lines")
    lines = _table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    lines.coalesce(1).sortWithinPartitions("event_id").select("line").write.text(path)
    return files.text_messages(spark, path, missing="raise").select(F.col("seq").alias("place"), "payload")


@query("SELECT CAST(i AS INTEGER) AS payload, CAST(i AS BIGINT) AS seq FROM range(3) t(i)")
def number_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.numbers(spark).select("payload", "seq")


@query("SELECT CAST(i AS VARCHAR) AS payload, CAST(i AS BIGINT) AS seq FROM range(3) t(i)")
def string_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.strings(spark).select("payload", "seq")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a', CAST(100 AS BIGINT)), (1, 'b', 350), (2, 'c', 350)) t(seq, payload, arrival_ms)")
def delayed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals are the sums of the delays before them."""
    return fixtures.delayed(spark, [("a", 100), ("b", 250), ("c", 0)]).select("seq", "payload", "arrival_ms")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, count(*) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS payload FROM orders")
def reduce_shared_by_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count over messages of four slots: the slots share its state."""
    source = Pipeline(_messages(spark, sf_dir, "orders", "o_orderkey", "o_orderkey"), "any")
    return (source | splitter(4) | reduce_running("count").with_slots(4)).dataframe().select("seq", "payload")


@query(f"""
WITH w AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 100 AS seq, event_type FROM events)
SELECT seq, count(*) FILTER (WHERE event_type = (SELECT min(event_type) FROM events)) AS payload FROM w GROUP BY 1
""")
def reduce_each_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that starts anew with every window of 100 messages."""
    rows = _messages(spark, sf_dir, "events", "event_type", "event_id")
    least = _table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    flow = Pipeline(rows) | window_count(100) | reduce_each(lambda n, x: n + (x == least), 0, "bigint")
    return flow.dataframe().select("seq", "payload")


_TYPES = "SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_type AS payload FROM events"


@query(_TYPES)
def sink_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Kept(shared_path(spark, "collected"))
    return (Pipeline(_messages(spark, sf_dir, "events", "event_type", "event_id")) | collect_into(found)).run().dataframe(spark)


@query(_TYPES.replace("event_type", "'> ' || event_type"))
def sink_printer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Kept(shared_path(spark, "printed"))
    return (Pipeline(_messages(spark, sf_dir, "events", "event_type", "event_id")) | printer("> ", lines)).run().dataframe(spark)


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, CAST(event_id AS VARCHAR) AS payload FROM events WHERE event_id % 2000 <> 0")
def sink_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback that raises for some payloads, which are passed over."""
    found = Kept(shared_path(spark, "called"))

    def take(text: str) -> str:
        if int(text) % 2000 == 0:
            raise ValueError(text)
        return text

    return (Pipeline(_messages(spark, sf_dir, "events", F.col("event_id").cast("string"), "event_id")) | collector(take, found)).run().dataframe(spark)


@query(_ARRIVALS + """
SELECT w.win AS seq, count(*) AS n FROM (SELECT win, q + 1 AS lo, coalesce(lead(q) OVER (ORDER BY win), 9223372036854775807) AS hi FROM t) w JOIN e ON e.seq BETWEEN w.lo AND w.hi GROUP BY 1
""")
def callable_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source | window | map of Python functions: each batch of texts becomes one of capitals."""
    rows = _messages(spark, sf_dir, "events", "event_type", "event_id", event_ts="ts")
    flow = callables.Source(rows) | callables.Window(DAY_MS, START_MS) | callables.Map(lambda texts: [t.upper() for t in texts])
    return flow.pipeline.dataframe().select("seq", F.size(F.filter("payload", lambda x: x == F.upper(x))).cast("bigint").alias("n"))


@query("SELECT * FROM (VALUES ('a stage without slots', 'ValueError'), ('a splitter into one slot', 'ValueError'), ('a stage after a sink', 'TypeError'), ('a batch stage on texts', 'TypeError'), ('a stream without a sink', 'TypeError')) t(what, error)")
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pipelines refuse when they are put together or started."""
    source = Pipeline(fixtures.strings(spark))
    cases = {
        "a stage without slots": lambda: filter_pattern("x").with_slots(0),
        "a splitter into one slot": lambda: splitter(1),
        "a stage after a sink": lambda: source | collect_into(Collected()) | filter_pattern("x"),
        "a batch stage on texts": lambda: source | embedder(embed.stub_client()),
        "a stream without a sink": lambda: (source | filter_pattern("x")).start(),
    }
    found = []
    for what, case in cases.items():
        try:
            case()
        except (TypeError, ValueError) as e:
            found.append((what, type(e).__name__))
    return spark.createDataFrame(found, "what string, error string")
