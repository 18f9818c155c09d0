"""A microblog server's public timeline: stream address, and events to posts."""

from __future__ import annotations

from urllib.parse import urlencode, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SERVER = "https://mastodon.social"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"


def stream_url(server: str = DEFAULT_SERVER, token: str | None = None) -> str:
    """The address of the public stream. It may hold a token: do not log it."""
    parts = urlsplit(server)
    scheme = "wss" if parts.scheme == "https" else "ws"
    host = parts.hostname or urlsplit(DEFAULT_SERVER).hostname
    return f"{scheme}://streaming.{host}/api/v1/streaming?{urlencode({'stream': 'public', 'access_token': token or ''})}"


def rfc3339(text: Column) -> Column:
    """The time of a text in RFC 3339, or null."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))


def posts(frames: DataFrame, column: str = "value") -> DataFrame:
    """(payload, event_ts, and the frame's seq if it has one) of the frames that are updates; all else is dropped, the stream goes on.

    The event's payload is itself JSON in a text; the post's HTML stays as it is.
    """
    outer = F.from_json(F.col(column), "event string, payload string")
    more = ["seq"] if "seq" in frames.columns else []
    rows = frames.select(outer.alias("o"), *more).filter("o.event = 'update'")
    inner = F.from_json(F.col("o.payload"), "content string, created_at string")
    rows = rows.select(inner.alias("p"), *more).select(F.col("p.content").alias("payload"), rfc3339(F.col("p.created_at")).alias("event_ts"), *more)
    return rows.filter("payload is not null and event_ts is not null")
