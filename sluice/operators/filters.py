"""Filters keep messages as they are, metadata and all."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import to_java


def by_pattern(df: DataFrame, pattern: str, column: str = "payload") -> DataFrame:
    """Rows in which the pattern is found anywhere; a bad pattern raises now, not at the first row."""
    return df.filter(F.col(column).rlike(to_java(pattern)))


def by_predicate(df: DataFrame, predicate: Column | Callable[[Column], Column], column: str = "payload") -> DataFrame:
    """Rows for which a Column, or a function from the payload's Column to one, is true."""
    return df.filter(predicate if isinstance(predicate, Column) else predicate(F.col(column)))


def by_callable(df: DataFrame, test: Callable[[str], bool], column: str = "payload") -> DataFrame:
    """Rows for which a Python function returns True; an exception or another result means no."""

    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        def one(value) -> bool:
            try:
                return test(value) is True
            except Exception:
                return False

        return values.map(one).astype(bool)

    return df.filter(passes(F.col(column)))


def everything(df: DataFrame) -> DataFrame:
    """The default filter: a pattern that is found in every text, empty or of many lines."""
    return df
