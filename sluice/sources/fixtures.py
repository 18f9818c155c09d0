"""Small sources with known content, and replays of messages with their arrival times."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _messages(df: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return df.select("payload", now.alias("event_ts"), now.alias("ingest_ts"), F.lit(None).cast("string").alias("source_id"), F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("slot"))


def numbers(spark: SparkSession, n: int = 3) -> DataFrame:
    return _messages(spark.range(n).select(F.col("id").cast("int").alias("payload"), F.col("id").alias("seq")))


def strings(spark: SparkSession, n: int = 3) -> DataFrame:
    return _messages(spark.range(n).select(F.col("id").cast("string").alias("payload"), F.col("id").alias("seq")))


def delayed(spark: SparkSession, items: Iterable[tuple[str, int]]) -> DataFrame:
    """Texts, each with the milliseconds that pass before it: ``arrival_ms`` adds them up from 0.

    The event time is the arrival; ``replay`` takes other times.
    """
    rows = spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate(items)], "seq bigint, payload string, delay bigint")
    order = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a fixture's few rows
    arrival = F.sum("delay").over(order)
    return rows.select("seq", "payload", arrival.alias("arrival_ms"), arrival.alias("event_ms"), F.lit(0).alias("slot"))


def replay(spark: SparkSession, items: Iterable[tuple[str, int, int | None]]) -> DataFrame:
    """Texts with arrival and event milliseconds; no event time means that of the arrival."""
    rows = [(i, p, a, a if e is None else e, 0) for i, (p, a, e) in enumerate(items)]
    return spark.createDataFrame(rows, "seq bigint, payload string, arrival_ms bigint, event_ms bigint, slot int")
