"""A social network's binary firehose: frames to posts.

A frame is two CBOR values, a header that does not matter here and a map with ``ops`` and ``blocks``.
Only the first op's action counts: if it is not "create" the frame gives nothing, else every block of
the archive is looked at, and those that are posts with a text and a proper time are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cbor import DecodeError, Reader, car_blocks, decode

URL = "wss://bsky.network/xrpc/com.atproto.sync.subscribeRepos"
POST = "app.bsky.feed.post"


def _millis(text: str) -> int | None:
    import re

    if not re.match(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\Z", text):
        return None
    body, zone = (text[:-1], "+00:00") if text[-1] in "Zz" else (text[:-6], text[-6:])
    whole, _, part = body.partition(".")
    try:
        at = datetime.fromisoformat(whole.replace("t", "T") + zone)
    except ValueError:
        return None
    return int(at.timestamp()) * 1000 + int((part + "000")[:3])


def _until_broken(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """An archive's blocks up to where it cannot be read any more: what was found before stays."""
    try:
        yield from blocks
    except DecodeError:
        return


def frame_posts(frame: bytes) -> list[tuple[str, int]]:
    """(text, event milliseconds) of a frame's posts; a frame that cannot be read raises DecodeError."""
    reader = Reader(frame)
    reader.value()
    body = reader.value()
    if not isinstance(body, dict) or not isinstance(body.get("ops"), list) or not isinstance(body.get("blocks"), bytes):
        raise DecodeError("a frame without ops or blocks")
    first = body["ops"][0] if body["ops"] else None
    if not isinstance(first, dict) or first.get("action") != "create":
        return []
    found = []
    for block in _until_broken(car_blocks(body["blocks"])):
        try:
            post = decode(block)
        except (DecodeError, TypeError):  # a map with a key that cannot be one
            continue
        if isinstance(post, dict) and post.get("$type") == POST and isinstance(post.get("text"), str) and isinstance(post.get("createdAt"), str):
            at = _millis(post["createdAt"])
            if at is not None:
                found.append((post["text"], at))
    return found


def posts(frames: DataFrame, column: str = "frame") -> DataFrame:
    """(payload, event_ts, and the frame's seq if it has one) of binary frames; frames that cannot be read are skipped."""
    more = ["seq"] if "seq" in frames.columns else []

    # Frames go to Python by the hundred; in Arrow's batches each worker holds thousands, and their posts, several times over.
    def read(found: bytes | None) -> list[tuple[str, int]]:
        try:
            return frame_posts(bytes(found))
        except (DecodeError, TypeError):
            return []

    made = F.udf(read, "array<struct<payload string, event_ms bigint>>", useArrow=False)
    rows = frames.select(F.explode(made(column)).alias("post"), *more)
    return rows.select("post.payload", F.timestamp_millis("post.event_ms").alias("event_ts"), *more)


def frame(text: str, created_at: str, action: str = "create", kind: str = POST) -> bytes:
    """A frame with one post, to replay and to test with."""
    from .cbor import encode, encode_car

    block = encode({"$type": kind, "text": text, "createdAt": created_at})
    return encode({"op": 1, "t": "#commit"}) + encode({"ops": [{"action": action, "path": "p"}], "blocks": encode_car([block]), "seq": 1})
