"""Sinks: printing, callbacks, and folders."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pipeline import Kept, Stage


def _ordered(df: DataFrame) -> DataFrame:
    order = [c for c in ("slot", "seq", "win") if c in df.columns]
    return df.orderBy(*order) if order else df


def printer(prefix: str = "PrinterSink: ", out: Callable[[str], Any] | Kept = print) -> Stage:
    """Prints each payload behind the prefix, on the driver as it comes from the executors; with ``Kept`` the executors print, into its folder."""

    def lines(rows: DataFrame) -> DataFrame:
        return rows.select(F.concat(F.lit(prefix), F.coalesce(F.col("payload").cast("string"), F.lit("None"))).alias("payload"))

    def apply(df: DataFrame, _: int) -> Kept | None:
        if isinstance(out, Kept):
            return out.take(df, lines)
        for row in _ordered(df).select(F.col("payload").cast("string")).toLocalIterator():
            out(f"{prefix}{row[0]}")

    return Stage("printer", apply, gives="none", sink=True)


def collector(callback: Callable[[Any], Any], into: Kept | None = None, returns: str = "string") -> Stage:
    """Calls back on the driver for each payload; an exception is printed and the payload skipped.

    With ``into`` the executors call back, each for its part of the order, and what the callback returns is kept, of the
    declared type. A part that is done again after a loss is called back again.
    """

    def call(value: Any) -> tuple[bool, Any]:
        try:
            return True, callback(value)
        except Exception as e:
            print(f"collector failed: {e}")
            return False, None

    def called(rows: DataFrame) -> DataFrame:
        # A call has effects, so it may not be left out or made twice.
        made = F.udf(call, f"struct<done boolean, value {returns}>", useArrow=False).asNondeterministic()
        return rows.select(made("payload").alias("call")).filter("call.done").select(F.col("call.value").alias("payload"))

    def apply(df: DataFrame, _: int) -> Kept | None:
        if into is not None:
            return into.take(df, called)
        for row in _ordered(df).select("payload").toLocalIterator():
            try:
                callback(row[0])
            except Exception as e:
                print(f"collector failed: {e}")

    return Stage("collector", apply, gives="none", sink=True)


def parquet_folder(path: str) -> Stage:
    """Appends to a folder of Parquet files: each batch's part is written by the executors."""
    return Stage("parquet", lambda df, _: df.write.mode("append").parquet(path), gives="none", sink=True)


def frequent_words(counts: DataFrame, above: int = 20) -> DataFrame:
    """(win, word, cnt) of words that a window has more than ``above`` times."""
    return counts.filter(F.col("cnt") > above)
