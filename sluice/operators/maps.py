"""Maps: one message out for each message in, or one at most; metadata is kept."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def by_column(df: DataFrame, expression: Column | Callable[[Column], Column]) -> DataFrame:
    """The payload replaced by a Column, or by what a function makes of the payload's Column."""
    return df.withColumn("payload", expression if isinstance(expression, Column) else expression(F.col("payload")))


def by_callable(df: DataFrame, function: Callable[[Any], Any], returns: str) -> DataFrame:
    """The payload replaced by a Python function's result, of a declared type; exceptions raise."""

    kind = to_arrow_type(_parse_datatype_string(returns))

    # Values as Arrow has them: a Series would turn integers beside nulls into floats.
    @F.arrow_udf(returns)
    def made(values: pa.Array) -> pa.Array:
        return pa.array([function(v) for v in values.to_pylist()], kind)

    return df.withColumn("payload", made(F.col("payload")))


def batches_or_empty(df: DataFrame, function: Callable[[list], list], returns: str = "array<string>") -> DataFrame:
    """A function over batches; where it raises, the result is an empty list."""

    @F.pandas_udf(returns)
    def made(values: pd.Series) -> pd.Series:
        def one(batch):
            try:
                return function(list(batch))
            except Exception as e:
                print(f"map failed: {e}")
                return []

        return values.map(one)

    return df.withColumn("payload", made(F.col("payload")))


def text_or_nothing(df: DataFrame, function: Callable[[str], Any]) -> DataFrame:
    """A function from text to text; where it raises or returns no text, the message goes.

    What comes out are new messages, so their metadata starts anew.
    """
    from ..message import reset

    @F.pandas_udf("string")
    def made(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                result = function(value)
            except Exception as e:
                print(f"component failed: {e}")
                return None
            return result if isinstance(result, str) else None

        return values.map(one).astype(object)

    return reset(df.withColumn("payload", made(F.col("payload"))).filter(F.col("payload").isNotNull()))


def doubled(df: DataFrame) -> DataFrame:
    return by_column(df, lambda x: x * 2)
