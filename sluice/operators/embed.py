"""Embedding stages: clients that are given, called in batches; failed calls drop what they were for.

A client maps texts to vectors. Keys and tokens come from the environment of the worker and are not
logged; a client without its key raises where it is made, not at each message.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[list[float]]]


def stub_client(dimension: int = 8) -> Client:
    """Vectors made from a digest of the text: no network, the same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[(b - 128) / 128.0 for b in hashlib.sha256(t.encode()).digest()[:dimension]] for t in texts]

    return embed


def numbers(values: list) -> list[float]:
    """Elements that are no numbers count as 0.0."""
    return [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0 for v in values]


def parse_batch_reply(reply: bytes | str) -> list[list[float]]:
    """Vectors of ``{"embeddings": [{"values": [..]}]}``; raises on any other reply."""
    return [numbers(e["values"]) for e in json.loads(reply)["embeddings"]]


def parse_flat_reply(reply: bytes | str) -> list[float]:
    """The vector of a reply that is a list of numbers; raises on any other reply."""
    found = json.loads(reply)
    if not isinstance(found, list):
        raise ValueError("the reply is not a list")
    return numbers(found)


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> bytes:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return reply.read()


class BatchHttpClient:
    """One request for a batch of texts, to a service that embeds contents by model name."""

    def __init__(self, url: str, model: str = "text-embedding-004", key_variable: str = "GEMINI_API_KEY", timeout: float = 30.0) -> None:
        if key_variable not in os.environ:
            raise KeyError(f"{key_variable} is not set")
        self.url, self.model, self.key_variable, self.timeout = url, model, key_variable, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = {"requests": [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}} for t in texts]}
        return parse_batch_reply(_post(self.url, body, {"x-goog-api-key": os.environ[self.key_variable]}, self.timeout))


class SingleHttpClient:
    """One request for each text, waiting for the model to be loaded."""

    def __init__(self, url: str, token_variable: str = "HUGGINGFACE_API_TOKEN", timeout: float = 30.0) -> None:
        if token_variable not in os.environ:
            raise KeyError(f"{token_variable} is not set")
        self.url, self.token_variable, self.timeout = url, token_variable, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        headers = {"Authorization": f"Bearer {os.environ[self.token_variable]}"}
        return [parse_flat_reply(_post(self.url, {"inputs": t, "options": {"wait_for_model": True}}, headers, self.timeout)) for t in texts]


def _called(call: Callable) -> Callable:
    """The call's result, or None where it fails; a worker logs the first failure of each kind."""
    seen: set[str] = set()

    def one(value):
        try:
            return call(value)
        except Exception as e:
            kind = type(e).__name__
            if kind not in seen:
                seen.add(kind)
                logging.getLogger(__name__).warning("an embedding call failed with %s; more of them are not logged", kind)
            return None

    return one


def _vector(values: Iterable | None) -> list[float | None] | None:
    """As Spark takes floats, which drops integers."""
    return None if values is None else [None if v is None else float(v) for v in values]


# Rows go to Python by the hundred: Arrow's ten thousand, or 64 MB of them, are held several times over by each worker.
def embed_batches(df: DataFrame, client: Client) -> DataFrame:
    """Arrays of texts become arrays of vectors, one call a message; a failed call drops its message."""
    call = _called(lambda batch: client(list(batch)))

    def made(batch: list[str]) -> list[list[float]] | None:
        found = call(batch)
        return None if found is None else [_vector(v) for v in found]

    return df.withColumn("payload", F.udf(made, "array<array<float>>", useArrow=False).asNondeterministic()("payload")).filter(F.col("payload").isNotNull())


def embed_texts(df: DataFrame, client: Client) -> DataFrame:
    """Texts become vectors, one call a text; a failed call drops its message."""
    call = _called(lambda text: client([text])[0])
    made = F.udf(lambda text: _vector(call(text)), "array<float>", useArrow=False).asNondeterministic()  # one call, filter or not
    return df.withColumn("payload", made("payload")).filter(F.col("payload").isNotNull())


def preview(df: DataFrame, first: int = 5) -> DataFrame:
    """(seq, n_vectors, place, dimension, head): for arrays of vectors, each with its 1-based place."""
    rows = df.select("seq", F.size("payload").alias("n_vectors"), F.posexplode("payload").alias("place", "v"))
    return rows.select("seq", "n_vectors", (F.col("place") + 1).alias("place"), F.size("v").alias("dimension"), F.slice("v", 1, first).alias("head"))
