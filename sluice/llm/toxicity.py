"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A text is cut, all of it, into windows of whole words of about ``WINDOW`` bytes. Each window is
compressed twice: with the ordinary dictionary, and with the ordinary dictionary followed by the toxic
one. What the second saves over the first, the window's gain, then comes from toxic content alone, as
chance matches of ordinary text are the same in both. Gains are weighed by the log of how much likelier
they are in toxic than in ordinary documents; the weights' sum, the greatest weights and the number
of windows meet a logistic threshold.

Toxic documents are ordinary for the most part, so a dictionary of all of their text would be one of
ordinary text. The toxic dictionary is trained on their text less what ordinary documents have as well:
a word stays if at least ``LEAST_DOCS`` toxic documents, and a hundredth of them, hold it, and if it is
``RATIO`` times as common among them as among ordinary ones. Weights and threshold are calibrated on
documents that no dictionary was trained on.

What is learnt comes from a bounded sample: of each class at most ``SAMPLE_DOCS`` labelled training
documents, whole texts of at most ``SAMPLE_CHARS`` characters, those with the least hashes of ids. In
the calibration each class weighs as much as it has labels in the whole table, so the threshold means
the same whether the sample was cut or not. Only texts and labels enter; language, source and id are
no inputs of a score. The held-out fifth (crc32 of the id mod 5 is 0) never trains or calibrates.
Scoring covers whole texts of all rows.

Defined results: null and empty texts have one empty window and no gain and get the score of such;
without enough labels of both classes every score is the share of toxic labels (0.0 with none). Repeated
labels count once, the greater one holds; rows without an id are no training rows, and of several texts
of one id the one with the least hash trains. Repeated rows give repeated rows, very long texts and
words are windows like any other, an empty table gives none, and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEVEL = 40, 3
#: Bytes of the dictionaries, and of the ordinary text's runs that the first is trained on.
ORDINARY_BYTES, TOXIC_BYTES, RUN = 65_536, 4_096, 96
LEAST_DOCS, RATIO = 5, 6.0
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
#: Gains are told apart up to this many bytes; the features are held below these limits.
MOST_GAIN, MOST_TOTAL, MOST_TOP = 24, 40.0, 15.0
#: A word of more bytes is cut into pieces of so many.
LONGEST = 256


def _words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split are ASCII only."""
    ws = (text or "").encode().lower().split()
    if ws and max(map(len, ws)) > LONGEST:
        return [w[i : i + LONGEST] for w in ws for i in range(0, len(w), LONGEST)]
    return ws


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The words in order, each with a space before it, in runs of ``size`` bytes at most or of one word."""
    ws = _words(text)
    if not ws:
        return [b""]
    line = b" " + b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1).tolist()
    found, start, last = [], 0, 0
    for end in ends:
        if end - start > size and last > start:
            found.append(line[start:last])
            start = last
        last = end
    found.append(line[start:])
    return found


class Coder:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        self._open()

    def _open(self) -> None:
        d = zstd.ZstdCompressionDict(self.content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        self._c = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def lengths(self, ws: list[bytes]) -> np.ndarray:
        compress = self._c.compress
        return np.fromiter((len(compress(w)) for w in ws), np.int64, len(ws))

    def __getstate__(self) -> bytes:
        return self.content

    def __setstate__(self, content: bytes) -> None:
        self.content = content
        self._open()


def _dictionary(samples: list[bytes], size: int) -> bytes:
    samples = [w for w in samples if len(w) >= 8]
    return zstd.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()


def own_words(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Words that toxic documents share and that are ``RATIO`` times as common there as elsewhere."""
    inside, outside = (Counter(w for t in texts for w in set(_words(t))) for texts in (toxic, ordinary))
    least = max(LEAST_DOCS, len(toxic) // 100)
    return {w for w, k in inside.items() if k >= least and k * len(ordinary) >= RATIO * (outside[w] + 1) * len(toxic)}


def toxic_samples(texts: list[str], own: set[bytes]) -> list[bytes]:
    """What is left of texts when only their ``own`` words stay, three words a sample."""
    kept = ([w for w in _words(t) if w in own] for t in texts)
    return [b" " + b" ".join(ws[i : i + 3]) for ws in kept for i in range(0, len(ws), 3)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a small ridge on standardised features: mean, scale, weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    """Two coders, weights of gains and a threshold; a constant where there is too little to learn."""

    def __init__(self, texts: list[str], toxic: np.ndarray, totals: tuple[int, int] | None = None) -> None:
        """``totals`` are the classes' labels in the whole table, of which the texts are a sample."""
        counts = np.array([(toxic == k).sum() for k in (0, 1)], float)
        totals = counts if totals is None else np.array(totals, float)
        self.constant = float(totals[1] / totals.sum()) if totals.sum() else 0.0
        self.coders: tuple[Coder, Coder] | None = None
        if counts.min() > 1:
            share = totals / np.maximum(counts, 1)
            try:
                self._learn(texts, toxic, share / (share * counts).sum() * counts.sum())
            except zstd.ZstdError:  # too little text for a dictionary
                self.coders = None

    def _learn(self, texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> None:
        # Of each class every other document trains dictionaries, and the rest calibrate.
        parts = {(label, k): [texts[i] for i in np.flatnonzero(toxic == label)[k::2]] for label in (0, 1) for k in (0, 1)}
        content = _dictionary([w for t in parts[0, 0] for w in windows(t, RUN)], ORDINARY_BYTES)
        found = _dictionary(toxic_samples(parts[1, 0], own_words(parts[1, 0], parts[0, 0])), TOXIC_BYTES)
        self.coders = (Coder(content), Coder(content + found))
        gains = [[self.gains(windows(t)) for t in parts[label, 1]] for label in (0, 1)]
        counts = np.stack([np.bincount(self._bins(np.concatenate(of)), minlength=MOST_GAIN + 1) for of in gains]) + 1.0
        shares = counts / counts.sum(axis=1, keepdims=True)
        # A greater gain never weighs less.
        self.weights = np.maximum.accumulate(np.log(shares[1] / shares[0]))
        y = np.repeat([0.0, 1.0], [len(of) for of in gains])
        self.line = _logistic(np.stack([self.features(g) for of in gains for g in of]), y, np.repeat(weight, [len(of) for of in gains]))

    @staticmethod
    def _bins(gains: np.ndarray) -> np.ndarray:
        return np.clip(gains, 0, MOST_GAIN)

    def gains(self, ws: list[bytes]) -> np.ndarray:
        return self.coders[0].lengths(ws) - self.coders[1].lengths(ws)

    def features(self, gains: np.ndarray) -> np.ndarray:
        weights = self.weights[self._bins(gains)]
        total = weights.sum()
        return np.array([np.clip(total, -4, 8), np.clip(total, -MOST_TOTAL, MOST_TOTAL), min(np.sort(weights)[-5:].clip(0).sum(), MOST_TOP), np.log1p(len(gains))])

    def score(self, text: str | None) -> float:
        if self.coders is None:
            return self.constant
        mean, scale, w = self.line
        z = (self.features(self.gains(windows(text))) - mean) / scale
        return float(1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The sample is picked among the labels' ids, which hold no texts; only its texts are fetched."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marks = marks.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    picked: list = []
    for label in (0, 1):
        picked += marks.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    ids = docs.schema["doc_id"].dataType.simpleString()
    # Two classes of sample_docs ids at most, so this is small whatever the tables are.
    sample = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], f"_doc {ids}, toxic int"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.char_length("text") <= SAMPLE_CHARS)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    found = rows.join(sample, F.col("doc_id") == F.col("_doc")).groupBy("doc_id").agg(F.first("toxic").alias("toxic"), one.alias("text")).collect()
    found.sort(key=lambda r: (r["toxic"], xxhash.xxh64_intdigest(str(r["doc_id"]).encode()), str(r["doc_id"])))
    return Model([r["text"] for r in found], np.array([r["toxic"] for r in found], np.int64), (totals.get(0, 0), totals.get(1, 0)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.score(t.as_py()) for t in batch.column(2)], pa.float64())], names=["doc_id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 0
    return docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ids}, held_out boolean, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
