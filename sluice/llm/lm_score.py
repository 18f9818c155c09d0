"""LM scoring of whole documents with a gated recurrent model learnt from the corpus.

1. Every token of every training document is counted. The vocabulary is a table and never meets
   the driver as a whole; what the driver gets is bounded: the ``KNOWN`` most frequent tokens of at
   most ``TOKEN_BYTES`` bytes, and the totals of the rest by ending.
2. The model's symbols are the ``HEAD`` most frequent tokens, the end, and ``RARE`` groups of all
   other tokens, grouped by their last two bytes. A grouped token's probability is the model's for
   its group times its smoothed share in the group; the shares of a group sum to one with one unit
   kept for unseen tokens, so that the whole stays a distribution.
3. The model is trained on all training documents, each seen once: they are dealt to rounds of
   growing size; in a round every partition trains on its own documents from the weights of the
   round before, and the weights are averaged, weighted by tokens, block by block on the executors.
4. Every document is scored in one pass. Tokens beyond the known ones leave it as (document, token,
   times) rows and meet their counts in a shuffled join.

Defined results: null and empty texts are one end token; a null doc_id counts as the empty text for
the split; repeated rows are scored once each and come out as often as they went in; an empty table
gives no rows; without training documents the model is uniform over unseen symbols. Extra columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import written

HEAD, RARE, KNOWN, TOKEN_BYTES = 4096, 128, 200_000, 64
HIDDEN, CLASSES, SEED = 16, 36, 7
#: Shares of the training documents in the rounds, by a hash of the document.
ROUNDS = (0.02, 0.10, 0.28, 0.60)
#: Distinct tokens that a worker holds before it hands on their counts.
HELD = 200_000
BLOCK = 8192
LOG10 = float(np.log(10.0))


def tokens(text: bytes | None) -> list[bytes]:
    """Words in ASCII lower case, of UTF-8; bytes.lower and bytes.split know ASCII only."""
    return (text or b"").lower().split()


def rare_group(token: bytes) -> int:
    return crc32(token[-2:]) % RARE


def _split(modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(0)) % modulus


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    # As bytes, so that workers neither decode nor encode them.
    return docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("tie"), (_split() == 1).alias("held_out"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over training documents; the end token is the null row's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.binary()), pa.array([ends, *counts.values()], pa.int64())], names=["token", "c"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                ends += 1
                if len(counts) > HELD:
                    yield flush()
                    ends = 0
        if counts or ends:
            yield flush()

    partial = _rows(docs).filter(~F.col("held_out")).select("text").mapInArrow(run, "token binary, c bigint")
    return partial.groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every worker needs of the counts; its size is bounded whatever the corpus."""

    def __init__(self, counts: DataFrame) -> None:
        words = counts.filter("token is not null")
        # Totals by ending: at most 65 793 endings of at most two bytes, with the null of the end token.
        ending = F.substring(F.col("token"), F.greatest(F.octet_length("token") - 1, F.lit(1)), F.lit(2))
        endings = counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
        self.ends = sum(int(r["c"]) for r in endings if r["e"] is None)
        self.n = sum(int(r["c"]) for r in endings)
        self.v = sum(int(r["v"]) for r in endings if r["e"] is not None) + (1 if self.ends else 0)
        # All tokens above a count that at most KNOWN reach: found from a histogram of counts (bounded,
        # 32 bins to a doubling), so no task has to keep the most frequent ones apart.
        short = words.filter(F.octet_length("token") <= TOKEN_BYTES).withColumn("bin", F.floor(F.log2("c") * 32).cast("int"))
        least, room = None, KNOWN
        for r in sorted(short.groupBy("bin").count().collect(), reverse=True):
            if r["count"] > room:
                break
            least, room = r["bin"], room - r["count"]
        top = short.filter(F.col("bin") >= least).select("token", "c").collect() if least is not None else []
        top.sort(key=lambda r: (-r["c"], bytes(r["token"])))
        self.known = {bytes(r[0]): r[1] for r in top}
        head = list(self.known)[:HEAD]
        group_c, group_v = np.zeros(RARE), np.zeros(RARE)
        for r in endings:
            if r["e"] is not None:
                g = rare_group(bytes(r["e"]))
                group_c[g] += r["c"]
                group_v[g] += r["v"]
        for w in head:
            group_c[rare_group(w)] -= self.known[w]
            group_v[rare_group(w)] -= 1
        self.group_total = group_c + 0.5 * (group_v + 1)
        counts_of = np.array([*(self.known[w] for w in head), self.ends, *group_c], np.float64)
        # Classes of about equal root-of-count mass, frequent symbols first.
        order = np.argsort(-counts_of, kind="stable")
        mass = np.cumsum(np.sqrt(counts_of[order] + 0.5))
        cut = np.searchsorted(mass, mass[-1] * np.arange(1, CLASSES) / CLASSES)
        self.bounds = np.unique(np.concatenate([[0], cut, [len(order)]]))
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        self.counts = counts_of[order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.end = int(number[len(head)])
        self.rare = number[len(head) + 1 :]
        # By place among the known tokens: symbol, base score, and share within the symbol (0 for head tokens).
        c = np.array([r[1] for r in top], np.float64)
        groups = np.array([rare_group(w) for w in self.known], np.int64)
        self.place = {w: i for i, w in enumerate(self.known)}
        self.symbol_at = np.where(np.arange(len(c)) < len(head), 0, self.rare[groups]) if len(c) else np.empty(0, np.int64)
        self.symbol_at[: len(head)] = number[: len(head)]
        self.base_at = np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))
        self.share_at = np.log10(c + 0.5) - np.log10(self.group_total[groups]) if len(c) else np.empty(0)
        self.share_at[: len(head)] = 0.0
        self.base_end = float(np.log10((self.ends + 0.5) / (self.n + 0.5 * (self.v + 1))))
        self.known = None

    def read(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Symbols of a document, the places of its known tokens, its other tokens and their groups."""
        get = self.place.get
        at = np.array([get(w, -1) for w in ws], np.int64)
        symbols = self.symbol_at[at] if len(self.symbol_at) else np.zeros(len(at), np.int64)
        unknown = np.flatnonzero(at < 0)
        others = [ws[i] for i in unknown.tolist()]
        groups = np.array([crc32(w[-2:]) for w in others], np.int64) % RARE
        symbols[unknown] = self.rare[groups]
        return symbols, at[at >= 0], others, groups


def _average(parts: DataFrame) -> dict[int, np.ndarray]:
    """Weights averaged block by block on the executors; the result has the model's fixed size."""

    def mean(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(group["x"].to_numpy())
        return pd.DataFrame({"block": [key[0]], "x": [np.average(rows, axis=0, weights=group["w"].to_numpy()).astype(np.float32)]})

    found = parts.groupBy("block").applyInPandas(mean, "block int, x array<float>").collect()
    return {r["block"]: np.array(r["x"], np.float32) for r in found}


def train(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    spark = docs.sparkSession
    params = gru.init(vocabulary.counts, vocabulary.bounds, HIDDEN, SEED)
    names = sorted(params)
    shared = spark.sparkContext.broadcast(vocabulary)
    at = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "tie"), F.lit(1_000_000)) / 1e6
    low = 0.0
    for share in ROUNDS:
        given = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            v = shared.value
            trainer = gru.Trainer(given.value, v.bounds, v.class_of, v.end)
            for batch in batches:
                for text in batch.column(0):
                    trainer.add(v.read(tokens(text.as_py()))[0])
            trainer.drain()
            if trainer.seen:
                flat = np.concatenate([trainer.p[k].reshape(-1) for k in names])
                blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([float(trainer.seen)] * len(blocks)), pa.array([b.tolist() for b in blocks], pa.list_(pa.float32()))], names=["block", "w", "x"])

        part = _rows(docs).filter(~F.col("held_out") & (at >= low) & (at < low + share if low + share < 0.999 else F.lit(True)))
        low += share
        means = _average(part.select("text").mapInArrow(run, "block int, w double, x array<float>"))
        if means:
            flat = np.concatenate([means[b] for b in sorted(means)])
            cuts = np.cumsum([params[k].size for k in names])[:-1]
            params = {k: x.reshape(params[k].shape) for k, x in zip(names, np.split(flat, cuts), strict=True)}
        given.unpersist()
    return params


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row a document."""
    spark = docs.sparkSession
    counts = written(count_tokens(docs), "vocabulary")
    vocabulary = Vocabulary(counts)
    params = train(docs, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, params))
    ids = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {ids}, tie bigint, held_out boolean, token binary, times bigint, n_tokens bigint, n_known bigint, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        group_log = np.log10(v.group_total)
        for batch in batches:
            documents, mains = [], []
            owners, rares, times = [], [], []
            for i, text in enumerate(batch.column("text")):
                symbols, known, others, groups = v.read(tokens(text.as_py()))
                counted = Counter(others)
                owners += [i] * len(counted)
                rares += counted
                times += counted.values()
                mains.append((len(symbols) + 1, len(known) + int(v.ends > 0), v.base_at[known].sum() + v.base_end, v.share_at[known].sum() - group_log[groups].sum()))
                documents.append(symbols)
            if not mains:
                continue
            m, none = np.array(mains).T, np.zeros(len(rares))
            m[3] += gru.score(p, v.bounds, v.class_of, v.end, documents) / LOG10
            at = np.concatenate([np.arange(len(documents)), np.array(owners, np.int64)])
            taken = batch.select(["doc_id", "tie", "held_out"]).take(pa.array(at))
            # A main row's token holds a space, so it equals no token and spreads over the join.
            rares = [*(f" {t}".encode() for t in batch.column("tie").to_pylist()), *rares]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(rares, pa.binary()), pa.array(np.concatenate([np.zeros(len(documents), np.int64), np.array(times, np.int64)])), *(pa.array(np.concatenate([x, none]).astype(k)) for x, k in zip(m, (np.int64, np.int64, np.float64, np.float64), strict=True))],
                names=["doc_id", "tie", "held_out", "token", "times", "n_tokens", "n_known", "base", "score"],
            )

    made = _rows(docs).mapInArrow(run, fields)
    rare_counts = counts.filter("token is not null").select(F.col("token").alias("_token"), "c")
    joined = made.join(rare_counts, F.col("token") == F.col("_token"), "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    smooth = F.log10(c + 0.5)
    whole = float(vocabulary.n + 0.5 * (vocabulary.v + 1))
    sums = joined.groupBy("doc_id", "tie", "held_out").agg(
        F.sum((times == 0).cast("bigint")).alias("rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + times * (smooth - float(np.log10(whole)))).alias("base_score"),
        F.sum(F.col("score") + times * smooth).alias("score"),
    )
    once = lambda name: (F.col(name) / F.col("rows"))
    return sums.select(
        "doc_id", "held_out", once("n_tokens").cast("bigint").alias("n_tokens"), once("n_known").cast("bigint").alias("n_known"),
        F.lit(vocabulary.n).cast("bigint").alias("train_tokens"), once("base_score").alias("base_score"), once("score").alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy"),
    ).drop("_copy")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
