"""The record envelope, its metadata rules, and a total order for bounded tables.

A message is a row with ``payload``, ``event_ts``, ``ingest_ts``, ``source_id``, ``seq`` and ``slot``.
``seq`` counts from 0 in the order of arrival, which Spark does not keep by itself; ``slot`` is the
parallel lane. Filters, maps and lane operators keep the metadata, windows and folds start it anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ("event_ts", "ingest_ts", "source_id", "seq", "slot")
#: Rows whose keys are looked at to balance the parts of a sort. Any bounds give the same order.
BOUND_SAMPLE = 20_000
#: Bytes of rows that a task sorts, about, and how many tasks there are at most; a table for few tasks is left to Spark.
PART_BYTES, MOST_TASKS, FEW_TASKS = 16 << 20, 4096, 8


def _holds_map(kind) -> bool:
    """Whether a type has a map in it, of which Spark makes no hash."""
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    sizes = []
    for field in df.schema.fields:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind.startswith(("array", "map", "struct")) and "variant" not in kind:
            column, kind = F.to_json(column), "string"
        sizes.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8 if kind in ("string", "binary") else F.lit(8))
    return reduce(lambda a, b: a + b, sizes)


@dataclass(frozen=True)
class Ranges:
    """How a table is dealt by ranges of a key: the bounds between them, and in how many tasks (0: as Spark would)."""

    bounds: list
    tasks: int


def ranges(df: DataFrame, key: str) -> Ranges:
    """Cuts of the key's range into about equal parts, from a sample of bounded size taken by hash; more of them for more bytes."""
    # The hash is of the whole row: by the key alone, a frequent key would come as one block and fill the sample.
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not _holds_map(df.schema[c].dataType)])
    rows = df.select(F.col(key).alias("k"), hashed.alias("h"), _bytes(df).alias("b")).filter("k is not null")
    found = rows.orderBy("h").limit(BOUND_SAMPLE).select("k", "b").collect()
    if not found:
        return Ranges([], 0)
    keys = sorted(r["k"] for r in found)
    n = len(keys) if len(keys) < BOUND_SAMPLE else df.count()
    tasks = min(math.ceil(n * sum(r["b"] for r in found) / len(found) / PART_BYTES), MOST_TASKS)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    return Ranges(sorted({keys[len(keys) * i // parts] for i in range(1, parts)}), tasks if tasks > FEW_TASKS else 0)


def _part(key: str, bounds: list, kind) -> Column:
    """How many bounds are not above the key (null: none), by binary search in a literal array."""
    steps = max(1, len(bounds).bit_length())
    padded = F.array(*[F.lit(b).cast(kind) for b in bounds], *[F.lit(None).cast(kind)] * ((1 << steps) - len(bounds)))
    powers = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), lambda at, p: F.when(F.get(padded, at + p - 1) <= F.col(key), at + p).otherwise(at))


def with_seq(df: DataFrame, *order_by: str, name: str = "seq", dealt: Ranges | None = None, within: str | None = None) -> DataFrame:
    """``df`` with its place, from 0, in the order of the given columns (ascending, nulls first).

    Rows are dealt by ranges of the first column, numbered within their range, and moved up by the
    count of the ranges before; no task sees all rows, and their number grows with the table. Order is
    total only if the columns are. With ``within`` the range's number is kept by that name: a task has whole ranges.
    """
    first = order_by[0]
    dealt = dealt or ranges(df, first)
    rows = df.withColumn("__part", _part(first, dealt.bounds, df.schema[first].dataType))
    sizes = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}  # one a range
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part] = total
        total += sizes[part]
    if not sizes:
        return df.withColumns({name: F.lit(0).cast("bigint")} | ({within: F.lit(0)} if within else {}))
    if dealt.tasks:
        rows = rows.repartitionById(len(dealt.bounds) + 1, "__part")  # a range each; by hash some would get several
    offsets = F.get(F.array(*[F.lit(starts.get(p, 0)).cast("bigint") for p in range(max(sizes) + 1)]), F.col("__part"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order_by))
    rows = rows.withColumn(name, (place - 1 + offsets).cast("bigint"))
    return rows.withColumnRenamed("__part", within) if within else rows.drop("__part")


def envelope(
    df: DataFrame,
    payload: Column | str,
    order_by: tuple[str, ...],
    event_ts: Column | str | None = None,
    ingest_ts: Column | str | None = None,
    source_id: str | None = None,
    dealt: Ranges | None = None,
) -> DataFrame:
    """A bounded table as messages; times that are not given are the query's time."""
    column = lambda c, other: other if c is None else F.col(c) if isinstance(c, str) else c
    ingest = column(ingest_ts, F.current_timestamp())
    ordered = with_seq(df, *order_by, dealt=dealt)
    return ordered.select(
        column(payload, None).alias("payload"),
        column(event_ts, ingest).cast("timestamp").alias("event_ts"),
        ingest.cast("timestamp").alias("ingest_ts"),
        F.lit(source_id).cast("string").alias("source_id"),
        "seq",
        F.lit(0).alias("slot"),
    )


def stream_envelope(df: DataFrame, payload: Column | str, event_ts: Column | str | None = None, source_id: str | None = None) -> DataFrame:
    """An unbounded DataFrame as messages; a ``seq`` that the source has is kept, else stages that need one number messages as they come."""
    column = lambda c, other: other if c is None else F.col(c) if isinstance(c, str) else c
    now = F.current_timestamp()
    return df.select(column(payload, None).alias("payload"), column(event_ts, now).cast("timestamp").alias("event_ts"), now.alias("ingest_ts"), F.lit(source_id).cast("string").alias("source_id"), F.lit(0).alias("slot"), *(["seq"] if "seq" in df.columns else []))


def with_new_payload(df: DataFrame, payload: Column) -> DataFrame:
    """Another payload under the same metadata."""
    return df.withColumn("payload", payload)


def with_source(df: DataFrame, source_id: str | None) -> DataFrame:
    """Metadata kept, the source set."""
    return df.withColumn("source_id", F.lit(source_id).cast("string"))


def sent(df: DataFrame, sender: str | None) -> DataFrame:
    """What a sender passes on: the source is overwritten only by a sender that has one."""
    return df if sender is None else with_source(df, sender)


def with_event_time(df: DataFrame, event_ts: Column) -> DataFrame:
    return df.withColumn("event_ts", event_ts.cast("timestamp")).withColumn("ingest_ts", F.current_timestamp())


def reset(df: DataFrame) -> DataFrame:
    """Metadata of messages that an operator makes anew."""
    now = F.current_timestamp()
    return df.withColumns({"event_ts": now, "ingest_ts": now, "source_id": F.lit(None).cast("string")})


def millis(column: Column | str) -> Column:
    """Unix milliseconds; before 1970 they are negative and do not wrap."""
    return F.unix_millis(F.col(column) if isinstance(column, str) else column)
