"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride files.

Documents are encoded and, with an end token after each, laid end to end within their input
partition; the stream is cut into sequences of ``SEQUENCE`` tokens, the last one of a partition
filled up with end tokens. A sequence's place in that order, counted over partitions, goes through a
Feistel network keyed by a seed; the network permutes a power of four, and places that fall outside
the number of sequences walk on through it until they fall inside. What comes out is the sequence's
slot: all slots are taken once and none has to be looked up. Rows go to the task of their slot's
range, which writes one file of ``SHARD_ROWS`` records of 2 * SEQUENCE bytes: slot s is at byte
(s mod SHARD_ROWS) * 2 * SEQUENCE of file s div SHARD_ROWS, so reading can start anywhere.

A task writes beside its file's place and renames, so one that is run again leaves the same file.
The manifest is written last; files without one are unfinished. Both passes read the same partitions,
and the second fails if a partition's count has changed between them.

Defined results: null and empty texts are one end token; repeated rows are repeated; without rows no
file is written. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import work_dir
from .shared_fs import SharedFolder

SEQUENCE, SHARD_ROWS, SEED, ROUNDS = 256, 32_768, 20250101, 6


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS) -> None:
        self.n, self.half = n, np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:8], "little")) for i in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = x ^ key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << self.half) | right

    def _walk(self, places: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        out = self._once(np.asarray(places, np.uint64), keys, back)
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slot(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys, False)

    def place(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


class ByteBpe:
    """An encoder's recipe: calling it on a worker gives a function from a text to its list of ids.

    The rank file is read where this is made, on the driver, and travels with it.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.pattern = load_ranks(path), pattern

    def __call__(self) -> Callable[[str], list[int]]:
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary


def _content(column: pa.BinaryArray) -> memoryview:
    """The values of a column without nulls, one behind the other."""
    edges = np.frombuffer(column.buffers()[1], np.int32)
    return memoryview(column.buffers()[2])[edges[column.offset] : edges[column.offset + len(column)]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def count_tokens(docs: DataFrame, shared) -> list[tuple[int, int]]:
    """(partition, tokens with ends), one row a partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = shared.value(), 0
        for batch in batches:
            # One text at a time, so that no more than its ids are held.
            for text in batch.column(1):
                n += len(encode(text.as_py())) + 1
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["p", "n"])

    return [(r["p"], r["n"]) for r in _texts(docs).mapInArrow(run, "p int, n bigint").collect() if r["n"]]


def materialise(
    docs: DataFrame,
    path: str,
    encoder: Callable,
    end_token: int,
    sequence: int = SEQUENCE,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> dict:
    """Writes the shards and the manifest below ``path``; returns the manifest."""
    spark = docs.sparkSession
    folder = SharedFolder(spark, path)
    shared = spark.sparkContext.broadcast(encoder)
    counts = dict(count_tokens(docs, shared))
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += -(-counts[p] // sequence)
    about = {"sequence": sequence, "stride": 2 * sequence, "shard_rows": shard_rows, "sequences": total, "seed": seed, "end_token": end_token, "partitions": sorted((p, starts[p], counts[p]) for p in counts)}
    n_shards = -(-total // shard_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, p = shared.value(), TaskContext.get().partitionId()
        order, at, seen, rest = Feistel(total, seed), starts.get(p, 0), 0, np.empty(0, "<u2")

        def rows(stream: np.ndarray, at: int) -> pa.RecordBatch:
            n = len(stream) // sequence
            slots = order.slot(np.arange(at, at + n))
            edges = pa.py_buffer(np.arange(0, (n + 1) * 2 * sequence, 2 * sequence, np.int32))
            ids = pa.Array.from_buffers(pa.binary(), n, [None, edges, pa.py_buffer(np.ascontiguousarray(stream))])
            return pa.RecordBatch.from_arrays([pa.array((slots // shard_rows).astype(np.int32)), pa.array(slots), ids], names=["shard", "slot", "ids"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                parts = [rest]
                for text in batch.column(1).slice(k, 256):
                    ids = encode(text.as_py())
                    ids.append(end_token)
                    parts.append(np.array(ids, "<u2"))
                    seen += len(ids)
                rest = np.concatenate(parts)
                whole = len(rest) // sequence * sequence
                if whole:
                    yield rows(rest[:whole], at)
                    at, rest = at + whole // sequence, rest[whole:]
        if seen != counts.get(p, 0):
            raise RuntimeError(f"partition {p} had {counts.get(p, 0)} tokens when counted and has {seen}")
        if len(rest):
            yield rows(np.concatenate([rest, np.full(sequence - len(rest), end_token, "<u2")]), at)

    target = folder.path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, fs, shard, n, slot = None, None, -1, 0, 0
        digest = hashlib.sha256()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column(0)[0].as_py()
                slot = shard * shard_rows
                fs, base = pafs.FileSystem.from_uri(target)
                place, beside = f"{base}/shard-{shard:06d}.bin", f"{base}/.shard-{shard:06d}.{TaskContext.get().taskAttemptId()}"
                out = fs.open_output_stream(beside)
            slots = batch.column(1).to_numpy()
            if not (slots == np.arange(slot, slot + len(slots))).all():
                raise RuntimeError(f"shard {shard} lacks slots from {slot}")
            data = _content(batch.column(2))
            out.write(data)
            digest.update(data)
            n, slot = n + len(slots), slot + len(slots)
        if out is not None:
            out.close()
            fs.move(beside, place)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n]), pa.array([digest.hexdigest()])], names=["shard", "records", "sha256"])

    if n_shards:
        dealt = _texts(docs).mapInArrow(cut, "shard int, slot bigint, ids binary").repartitionById(n_shards, "shard").sortWithinPartitions("slot")
        done = dealt.mapInArrow(write, "shard bigint, records bigint, sha256 string").collect()  # one row a file
    else:
        done = []
    about["shards"] = [{"shard": r["shard"], "records": r["records"], "sha256": r["sha256"]} for r in sorted(done, key=lambda r: r["shard"])]
    if sum(s["records"] for s in about["shards"]) != total:
        raise RuntimeError("the shards do not hold all sequences")
    folder.write_once("manifest.json", json.dumps(about))
    return about


class TrainingReader:
    """Sequences by slot, in order, from any slot on; the state to resume from is the next slot."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = SharedFolder(spark, path)
        self.about = json.loads(self.folder.read_text("manifest.json"))
        self.fs, self.base = pafs.FileSystem.from_uri(self.folder.path)

    def read(self, slot: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        rows, stride, total = self.about["shard_rows"], self.about["stride"], self.about["sequences"]
        stop = total if count is None else min(total, slot + count)
        while slot < stop:
            with self.fs.open_input_file(f"{self.base}/shard-{slot // rows:06d}.bin") as f:
                f.seek(slot % rows * stride)
                while slot < stop:
                    yield slot, np.frombuffer(f.read(stride), "<u2")
                    slot += 1
                    if slot % rows == 0:
                        break


def op10_token_shards(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All sequences as read back from the files: slot, place in the corpus order, digest of the ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = work_dir(spark, "token-shards")
    encoder = ByteBpe(tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    about = materialise(docs, path, encoder, end_token=50_256)
    return read_back(spark, path, about)


def read_back(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """(slot, place, shard, n_tokens, ids_sha256) of every record of the written files."""
    target, rows, stride, total = SharedFolder(spark, path).path, about["shard_rows"], about["stride"], about["sequences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(target)
        order = Feistel(total, about["seed"])
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/shard-{shard:06d}.bin") as f:
                    slot = shard * rows
                    while data := f.read(4096 * stride):
                        n = len(data) // stride
                        slots = np.arange(slot, slot + n)
                        ends = np.frombuffer(data, "<u2").reshape(n, -1) == about["end_token"]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slots), pa.array(order.place(slots)), pa.array(np.full(n, shard)), pa.array(ends.sum(axis=1).astype(np.int64)), pa.array([hashlib.sha256(data[i : i + stride]).hexdigest() for i in range(0, len(data), stride)])],
                            names=["slot", "place", "shard", "n_ends", "ids_sha256"],
                        )
                        slot += n

    shards = spark.range(0, len(about["shards"]), 1, max(1, len(about["shards"])))
    return shards.mapInArrow(run, "slot bigint, place bigint, shard bigint, n_ends bigint, ids_sha256 string")
