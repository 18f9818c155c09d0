"""Spark sessions with the settings that the engine counts on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(app: str = "sluice", **settings: str) -> SparkSession:
    """A session in UTC with AQE and a RocksDB state store; ``settings`` have __ for dots.

    Shuffle partitions and file split sizes are left to the cluster's own configuration.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder's path in the checkpoint folder that the session names, or else in its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
