"""Text files as messages, a line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

_LINES = StructType([StructField("payload", StringType())])


def _payload(df: DataFrame) -> DataFrame:
    # Lines end at \n; one \r before it goes, any other stays.
    return df.select(F.regexp_replace("value", "\r\\z", "").alias("payload"))


def text_lines(spark: SparkSession, path: str, missing: str = "empty") -> DataFrame:
    """The lines of a file, blank ones too. A missing path gives no lines, or raises if ``missing`` is "raise"."""
    try:
        return _payload(spark.read.text(path, lineSep="\n"))
    except AnalysisException:
        if missing == "raise":
            raise
        print(f"{path} cannot be read")
        return spark.createDataFrame([], _LINES)


def text_messages(spark: SparkSession, path: str, missing: str = "empty") -> DataFrame:
    """The lines of a file as messages in the order of the file."""
    rows = text_lines(spark, path, missing)
    # A file's splits are numbered in its order, so this orders lines without moving them.
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    from ..message import envelope

    return envelope(rows, "payload", ("__at",))


def text_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files below a folder as a stream of lines; the option bounds a micro-batch."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _payload(reader.text(path))
