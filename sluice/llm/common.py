"""Shared pieces of the training-data operators: words, table access, work folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract: space and the five ASCII controls tab to carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(present(text), GAP_RE, -1), lambda w: w != F.lit(""))


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder's path below the shared checkpoint folder that the session names.

    Where it names none, as in local tests, a folder below the warehouse becomes it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept:
            spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
            kept = spark.sparkContext.getCheckpointDir()
        root = kept
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage, survives executors."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a ``written`` table that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Marked for broadcast if its counted rows fit the limit; else left to a shuffled join.

    Counting runs the plan of ``df``, which should therefore be a written table or cheap.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
