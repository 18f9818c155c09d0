"""SimHash near-duplicates by tiled exact comparison of all fingerprints.

A text's fingerprint has a bit set if more than half of the XXH64 hashes of its word shingles have
it set. Equal fingerprints are one row from then on. Rows fall into bins (for op6, by population
count; the bins' counts go to the driver, nothing that grows), and bins are cut into blocks by hash.
Each block is written once, as a file of the shared folder; from then on a row is a pair of blocks
whose bins are within reach of each other, and a task reads the two blocks of its pair, in which numpy
compares tiles by exclusive-or and bit counts. Tiles hold rows that are alike in the population counts
of their four quarters, so that most pairs of tiles are skipped by the sum of these counts' least
differences, a lower bound on the bits that differ. A pair of blocks gives a spanning forest of its
links, not the links, so a group of copies costs rows in proportion to its members.

Comparing takes time in the square of the number of different fingerprints, as the method has it;
rows, shuffled bytes and memory do not: a pair of blocks holds two blocks of ``MOST_BLOCK`` rows.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other; very long texts are hashed in chunks; rows of equal id are rows of their own; a
null id never becomes a component's id unless the whole component has null ids. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, n_partitions, small, work_dir, written
from .components import components
from .shared_fs import SharedFolder

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
TILE = 256
#: Rows of a block: a 32nd of all, within these bounds; a pair of blocks is one task's memory.
LEAST_BLOCK, MOST_BLOCK = 4096, 262_144
#: Shingles whose bits are counted at once, and compared pairs held at once.
CHUNK, PAIRS = 65_536, 1 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """(hashes, words): each hash and further ones that are mixed from it."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        x = hashes + np.uint64(k * int(_MIX[2]) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of one or more words) have each bit set, lowest bit of the first word first."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    # Up to 255 rows a byte holds the sum.
    return sum((bits[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255)), np.zeros(bits.shape[1], np.int64))


def text_simhash(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned 64-bit number. bytes.lower and bytes.split are ASCII only."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(ws) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(ws)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        ones += set_bits(np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], np.uint64))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhashes(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tie, fp) of every row; fp holds the 64 bits as a signed long, tie is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_simhash(t.as_py(), width) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "tie", "fp"])

    ids, text = docs.schema["doc_id"].dataType.simpleString(), F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, f"doc_id {ids}, tie bigint, fp bigint")


class Block(NamedTuple):
    """Rows to compare: ids, fingerprints (rows, words) and what tiles are sorted and skipped by (rows, columns)."""

    ids: np.ndarray
    bits: np.ndarray
    keys: np.ndarray
    #: What rows stand for, by id, where it is looked at.
    sets: dict[int, np.ndarray] = {}  # noqa: RUF012


def quarter_counts(bits: np.ndarray) -> np.ndarray:
    """Population counts of the quarters of each fingerprint's first word."""
    return np.bitwise_count(np.ascontiguousarray(bits[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Tiles:
    """A block's rows in the order of their keys, as full tiles (the last row repeated)."""

    def __init__(self, block: Block) -> None:
        order = np.lexsort(block.keys.T[::-1])
        order = np.concatenate([order, np.repeat(order[-1:], -len(order) % TILE)])
        keys = block.keys[order].reshape(-1, TILE, block.keys.shape[1])
        self.rows, self.first = order.reshape(-1, TILE), block.bits[order, 0].reshape(-1, TILE)
        self.low, self.high = keys.min(axis=1), keys.max(axis=1)

    def near(self, other: Tiles, k: int, reach: float) -> np.ndarray:
        """Tiles of ``other`` that may hold rows whose keys differ from those of tile k by ``reach`` at most, in sum."""
        gap = np.maximum(0, np.maximum(other.low - self.high[k], self.low[k] - other.high)).sum(axis=1)
        return np.flatnonzero(gap <= reach)


def close_rows(one: Block, two: Block, within: bool, radius: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of ``one``, of ``two``) whose first words differ in at most ``radius`` bits; ``within`` says that both are the same rows."""
    if not (len(one.ids) and len(two.ids)):
        return
    a = Tiles(one)
    b = a if within else Tiles(two)
    step = max(1, PAIRS // (TILE * TILE))
    for k in range(len(a.rows)):
        near = a.near(b, k, reach)
        if within:
            near = near[near >= k]
        for at in range(0, len(near), step):
            pick = near[at : at + step]
            i, j = np.nonzero(np.bitwise_count(a.first[k][:, None] ^ b.first[pick].reshape(1, -1)) <= radius)
            if len(i):
                yield a.rows[k][i], b.rows[pick].reshape(-1)[j]


class Forest:
    """Trees over rows; ``edges`` are the joined pairs of rows that made them."""

    def __init__(self, n: int) -> None:
        self.root, self.edges = np.arange(n), []

    def join(self, one: np.ndarray, two: np.ndarray) -> None:
        a, b = self.root[one], self.root[two]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        # One pair of each two trees is enough.
        _, first = np.unique(np.minimum(a, b)[apart] * len(self.root) + np.maximum(a, b)[apart], return_index=True)
        root = self.root
        for i in apart[first].tolist():
            x, y = int(a[i]), int(b[i])
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                self.edges.append((int(one[i]), int(two[i])))
        while not ((up := root[root]) == root).all():
            root[:] = up


def linked(one: Block, two: Block, within: bool, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the rows of ``one`` and, numbered behind them, ``two`` that differ in at most ``radius`` bits of one word."""
    shift = 0 if within else len(one.ids)
    forest = Forest(len(one.ids) + (0 if within else len(two.ids)))
    for i, j in close_rows(one, two, within, radius, radius):
        forest.join(i, j + shift)
    return forest.edges


class Blocks:
    """Rows dealt to files of the shared folder, and the pairs of them that have to be compared.

    ``rows`` has id (a long), bin and what else ``read`` needs. Rows are compared if their bins, of
    [0, n_bins), differ by ``reach`` at most.
    """

    def __init__(self, rows: DataFrame, n_bins: int, reach: int) -> None:
        self.spark = rows.sparkSession
        found = {r[0]: r[1] for r in rows.groupBy("bin").count().collect()}  # n_bins rows at most
        size = min(MOST_BLOCK, max(LEAST_BLOCK, -(-sum(found.values()) // 32)))
        blocks = [-(-found.get(p, 0) // size) for p in range(n_bins)]
        self.base = np.concatenate([[0], np.cumsum(blocks)]).tolist()
        self.n_bins, self.reach = n_bins, reach
        of = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("bin"))
        self._own = of(self.base[:-1]) + F.pmod(F.xxhash64("id"), of([max(1, b) for b in blocks])).cast("int")
        self.folder = SharedFolder(self.spark, work_dir(self.spark, "blocks"))
        self.write(rows, "rows")

    def write(self, rows: DataFrame, name: str) -> None:
        """Rows with id and bin, as files of the blocks that they belong to."""
        dealt = rows.withColumn("block", self._own).drop("bin")
        dealt = dealt.repartition(max(n_partitions(self.spark), min(self.base[-1], 64 * n_partitions(self.spark))), "block")
        dealt.write.mode("overwrite").partitionBy("block").parquet(self.folder.under(name))

    def pairs(self) -> DataFrame:
        """(x, y): blocks to be compared, y not before x, each pair once."""
        n, base = self.base[-1], self.base
        starts = F.array(*[F.lit(int(v)) for v in base[:-1]])
        last = F.array(*[F.lit(int(base[min(self.n_bins, p + self.reach + 1)] - 1)) for p in range(self.n_bins)])
        x = F.col("id").cast("int")
        # Empty bins share their start with the next; the last bin that starts at or before x is x's.
        bin_of = F.size(F.filter(starts, lambda s: s <= x)) - 1
        pairs = self.spark.range(n).select(x.alias("x"), F.explode(F.sequence(x, F.get(last, bin_of))).alias("y"))
        parts = max(n_partitions(self.spark), min(n * n // 8 + 1, 64 * n_partitions(self.spark)))
        return pairs.repartition(parts, F.xxhash64("x", "y")).sortWithinPartitions("x", "y")

    def compared(self, read: Reader, compare: Comparer, names: tuple[str, ...] = ("rows",)) -> DataFrame:
        """(a, b): ids of the pairs of rows that ``compare`` gives for each pair of blocks, which ``read`` makes of their tables."""
        target = self.folder.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = pafs.FileSystem.from_uri(target)
            held: dict[int, Block] = {}

            def block(k: int) -> Block:
                if k not in held:
                    held[k] = read(*(table(f"{base}/{name}/block={k}") for name in names))
                return held[k]

            def table(path: str) -> pa.Table | None:
                files = [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
                return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in files]) if files else None

            for batch in batches:
                for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    one, two = block(x), block(y)
                    found = np.array(compare(one, two, x == y), np.int64).reshape(-1, 2)
                    ids = one.ids if x == y else np.concatenate([one.ids, two.ids])
                    for k in [k for k in held if k not in (x, y)]:
                        del held[k]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["a", "b"])

        return self.pairs().mapInArrow(run, "a bigint, b bigint")

    def delete(self) -> None:
        self.folder.delete("")


Reader = Callable[..., Block]
Comparer = Callable[[Block, Block, bool], list[tuple[int, int]]]


def _fingerprint_block(table: pa.Table | None) -> Block:
    ids = table.column("id").to_numpy() if table is not None else np.zeros(0, np.int64)
    bits = ids.view(np.uint64).reshape(-1, 1)
    return Block(ids, bits, quarter_counts(bits))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), written: edges that connect exactly the fingerprints linked at the radius; ``fps`` are distinct."""
    blocks = Blocks(fps.select(F.col("fp").alias("id"), F.bit_count("fp").alias("bin")), 65, radius)
    found = written(blocks.compared(_fingerprint_block, lambda one, two, within: linked(one, two, within, radius)), "links")
    blocks.delete()
    return found


def near_groups(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tie, fp, component_id) of every row; component_id is the least doc_id linked to it."""
    marked = written(simhashes(docs, width), "simhash")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    edges = links(fps.select("fp"), radius)
    roots = written(components(edges), "roots")
    dropped(edges)
    classes = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = classes.select(F.col("fp").alias("_fp"), "root").join(named, "root").select("_fp", "root", "component_id")
    return marked.join(by_fp, marked["fp"] == by_fp["_fp"]).select("doc_id", "tie", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each group: that of least id (then least hash of the text; null ids last).

    Rows of one id and text are told apart by nothing; one of them stays.
    """
    return one_of_groups(docs, near_groups(docs, radius, width))


def one_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each root of ``groups``, which has (doc_id, tie, root) of every row."""
    groups = written(groups, "groups")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")
    keys = groups.groupBy("doc_id", "tie", "root").agg(F.count(F.lit(1)).alias("copies"))
    first = groups.groupBy("root").agg(F.min(place).alias("first")).select(F.col("root").alias("_root"), "first")
    judged = keys.join(first, F.col("root") == F.col("_root"))
    stays = F.col("first") == place
    marks = judged.filter(~stays | (F.col("copies") > 1)).select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), stays.alias("_stays"))
    marks = small(written(marks, "marks"), 24)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_tie"))
    rows = rows.join(marks, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t")), "left")
    out = rows.filter(F.col("_stays").isNull())
    if marks.filter("_stays").head(1):
        out = out.unionByName(rows.filter("_stays").dropDuplicates(["_doc", "_tie"]))
    return out.select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
