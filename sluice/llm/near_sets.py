"""Near-duplicate documents by SimHash of word shingles, held against the shingles themselves.

Texts are sets of 64-bit hashes of ``width`` words in a row (all words, if there are fewer). Two are
linked if the sets' Jaccard similarity is ``PERCENT`` or more, and groups are the components of the
links. Equal sets are one row from then on. A set has a fingerprint of ``WORDS`` times 64 bits, and
all fingerprints are compared in tiles as ``simhash`` has it. Sets of a similarity of 0.8 differ in a
bit with a chance of 0.1612 at most (0.1875 for sets of four or five; computed for all sizes), so
linked sets are within ``RADIUS`` bits but for about one in 4000 that are just similar enough. Pairs
whose sizes alone rule a link out are not compared: rows are binned by the logarithm of their size.

What the comparison finds are candidates, and no candidate counts before it is verified. A first
comparison gives the rows that have any, and only their sets are written, beside their blocks. A second
one holds candidates, the nearest first, against the sets where no verified link connects them yet; a pair of
blocks gives the forest of its verified links. Every candidate is thus verified or connected, and a
group gives rows in proportion to its members, whatever they are like.

Defined results: case counts; null texts and texts without words are the empty set, which is linked
to itself only; very long texts are one set like any other; rows of equal id are rows of their own; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, written
from .components import components
from .simhash import Block, Blocks, Forest, close_rows, one_of_groups, set_bits, spread

SHINGLE_WORDS, SEED, PERCENT = 5, 42, 80
#: Words of a fingerprint; bits in which linked sets differ at most, also those of up to five shingles, in all words and in the first.
WORDS, RADIUS, SMALL_RADIUS, FIRST_RADIUS = 16, 206, 236, 23
#: The same by the number of words compared so far: what a part of the bits differs in varies more.
LIMITS = [[min(most, round(64 * k * p + 4.5 * (64 * k * p * (1 - p)) ** 0.5)) for k in range(1, WORDS + 1)] for most, p in ((RADIUS, 0.1612), (SMALL_RADIUS, 0.1875))]
#: Candidates of a pair of blocks that are held before they are verified, and verified before the rest is looked through.
HELD, TURN = 1 << 20, 4096


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The different hashes of a text's shingles in rising order. bytes.split is ASCII only."""
    ws = (text or "").encode().split()
    if not ws:
        return np.zeros(0, np.int64)
    line = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: max(1, len(ws) - width + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(width, len(ws)) - 1 :].tolist(), strict=True)], np.uint64).view(np.int64))


def fingerprint(shingles: np.ndarray, words: int = WORDS) -> bytes:
    """A bit is set if more than half of the hashes have it set; none for the empty set."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(shingles), 8192):
        ones += set_bits(spread(shingles[at : at + 8192].view(np.uint64), words))
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tie, id, n, bits) of every row: a hash of the text, the set's hash, size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(ids), pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "id", "n", "bits"])

    ids, text = docs.schema["doc_id"].dataType.simpleString(), F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {ids}, tie bigint, id bigint, n int, bits binary")


def _block(table: pa.Table | None, sets: pa.Table | None = None) -> Block:
    """Rows of a block's file; tiles go by the sets' sizes, whose logarithms to the base 100 / PERCENT differ by 1 at most."""
    if table is None:
        return Block(np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64), np.zeros((0, 1)))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, WORDS)
    held = {} if sets is None else {i: np.frombuffer(x, np.int64) for i, x in zip(sets.column("id").to_pylist(), sets.column("shingles").to_pylist(), strict=True)}
    return Block(table.column("id").to_numpy(), bits, _size_key(table.column("n").to_numpy())[:, None], held)


def _size_key(n: np.ndarray) -> np.ndarray:
    return np.log(n) / np.log(100 / PERCENT)


def _candidates(one: Block, two: Block, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (of ``one``, of ``two``) within the radius, and the bits in which they differ."""
    few = _size_key(np.array([5.5]))[0]
    for i, j in close_rows(one, two, within, FIRST_RADIUS, 1 + 1e-9):
        near = np.flatnonzero((np.abs(one.keys[i, 0] - two.keys[j, 0]) <= 1 + 1e-9) & ((i != j) if within else True))
        i, j = i[near], j[near]
        distance = np.bitwise_count(one.bits[i, 0] ^ two.bits[j, 0]).astype(np.int16)
        for k in range(1, WORDS):
            distance += np.bitwise_count(one.bits[i, k] ^ two.bits[j, k])
            stay = np.flatnonzero(distance <= np.where(one.keys[i, 0] < few, LIMITS[1][k], LIMITS[0][k]))
            if len(stay) < len(i):
                i, j, distance = i[stay], j[stay], distance[stay]
        if len(i):
            yield i, j, distance


def with_candidates(one: Block, two: Block, within: bool) -> list[tuple[int, int]]:
    """Rows that have a candidate, each as a pair with itself."""
    shift = 0 if within else len(one.ids)
    found = np.zeros(shift + len(two.ids), bool)
    for i, j, _ in _candidates(one, two, within):
        found[i] = found[j + shift] = True
    return [(k, k) for k in np.flatnonzero(found).tolist()]


def verified(one: Block, two: Block, within: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of ``one`` and, numbered behind them, ``two``."""
    shift = 0 if within else len(one.ids)
    forest = Forest(shift + len(two.ids))
    held: list[np.ndarray] = []

    def linked(i: int, j: int) -> bool:
        x, y = one.sets[int(one.ids[i])], two.sets[int(two.ids[j])]
        common = len(x) + len(y) - len(np.union1d(x, y))
        return (100 + PERCENT) * common >= PERCENT * (len(x) + len(y))

    def judge() -> None:
        rest = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
        held.clear()
        rest = rest[np.argsort(rest[:, 2], kind="stable")]
        while len(rest):
            for i, j, _ in rest[:TURN].tolist():
                if forest.root[i] != forest.root[j + shift] and linked(i, j):
                    forest.join(np.array([i]), np.array([j + shift]))
            rest = rest[TURN:]
            rest = rest[forest.root[rest[:, 0]] != forest.root[rest[:, 1] + shift]]

    for i, j, distance in _candidates(one, two, within):
        apart = np.flatnonzero(forest.root[i] != forest.root[j + shift])
        held.append(np.column_stack([i, j, distance])[apart])
        if sum(map(len, held)) > HELD:
            judge()
    judge()
    return forest.edges


def _written_sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles as bytes) of the sets of these ids, once each."""
    ties = written(marked.select("id", "tie").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("tie").alias("_tie")), "ties")
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("tie"), text.alias("text")).join(small(ties, 24), F.col("tie") == F.col("_tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "shingles"])

    # Equal texts are one before their sets are made.
    once = texts.groupBy("id").agg(F.min("text").alias("text"))
    found = written(once.mapInArrow(run, "id bigint, shingles binary"), "sets")
    dropped(ties)
    return found


def set_links(docs: DataFrame, marked: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(a, b), written: edges that connect the sets linked; ``marked`` is written ``fingerprints``."""
    bins = int(np.ceil(_size_key(np.array([2.0**31]))[0])) + 1
    bin_ = F.floor(F.ln("n") / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    distinct = marked.filter("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    distinct = written(distinct.withColumn("bin", bin_), "distinct")
    blocks = Blocks(distinct, bins, 1)
    wanted = written(blocks.compared(_block, with_candidates).select(F.col("a").alias("id")).distinct(), "candidates")
    sets = _written_sets(docs, marked, wanted, width)
    blocks.write(sets.join(distinct.select("id", "bin"), "id"), "sets")
    found = written(blocks.compared(_block, verified, ("rows", "sets")), "links")
    blocks.delete()
    for table in (distinct, wanted, sets):
        dropped(table)
    return found


def near_groups(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tie, root) of every row; rows of one group have one root."""
    marked = written(fingerprints(docs, width), "fingerprints")
    edges = set_links(docs, marked, width)
    roots = written(components(edges), "roots")
    dropped(edges)
    return marked.join(roots, F.col("id") == F.col("node"), "left").select("doc_id", "tie", F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each group, chosen as ``simhash.one_of_each`` does."""
    return one_of_groups(docs, near_groups(docs, width))
