"""Byte-level BPE encoding and decoding; the merges are a fold of Spark's higher-order functions.

1. Words. A text is split into words by the tokenizer's pattern. The words of all texts are counted;
   the most frequent (those that occur twice or more, ``TABLE_WORDS`` at most, of ``TABLE_BYTES``
   bytes at most) are folded first and become a table that is broadcast. It is a cache: all
   words of all texts are encoded, in it or not.
2. Coding. A document becomes the ids of its words from the table, with a mark in place of any other
   word, and the byte arrays of its distinct other words.
3. Fold. Each such byte array starts as the ids of its bytes. The fold merges the neighbours whose
   merged rank is least, the first of equals, until no two neighbours have one. The rank map is a
   literal: for a pair of ids, the rank of the two joined; a key stands at one of two places of an
   array, so a lookup reads two entries at most and not the 108 000 of a map column.
4. The folded words take the marks' places. Decoding joins the pieces of the ids as bytes.

The table decides how often a fold runs, never what it gives. The fold looks at all of a word for
each merge, so a word of more than ``LONG_BYTES`` bytes without a break is merged from a heap instead,
in n log n: the same merges in the same order. Frequent words are looked up and ids hashed in Arrow
batches: as columns of higher-order functions, which are interpreted, that took several times the
seconds (README).

Defined results: null and empty texts have no ids and decode to nothing (the hash of an empty
string). Repeated rows give repeated rows; an empty table gives none. Very long texts are coded in
pieces. Columns that are asked for pass unread, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, let, written
from .splitting import Hashes, Words, gathered, runs, same, splitter

NONE = 1 << 30
TABLE_WORDS, TABLE_BYTES, LONG_BYTES = 600_000, 40, 256
#: Different words that a worker counts before it hands them on.
HELD = 100_000
#: Stands before the two digits of a word's number; no id is as great.
MARK = 0xFFFF
#: Documents that a worker codes at once, and bytes of codes that it digests at once, whatever the
#: size of the batches that it is given; one document is never divided.
SLICE, DIGEST_BYTES, PART = 512, 1 << 19, 1 << 16
#: Rows of a batch between Spark and its workers while documents are coded, and the setting's name.
ROWS, BATCH_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Entries for each key of a two-place table; under half full, places can be found for all.
ROOM = 2.1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file on the driver: a line holds a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def weighed(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices with about ``DIGEST_BYTES`` in a column of bytes, one row at least."""
    for batch in batches:
        _, starts, sizes = _runs(batch.column(column))
        ends, at = starts + sizes, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + DIGEST_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


class Strings:
    """Byte strings by number, as one array."""

    def __init__(self, strings: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int32, len(strings))
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        """A part of the ids at a time, as places take more room than what they point to."""
        parts = (ids[i : i + PART] for i in range(0, len(ids), PART))
        return b"".join([gathered(self.flat, self.starts.take(x), self.sizes.take(x)).tobytes() for x in parts])


def heap_merged(word: bytes, rank: Callable[[bytes], int | None]) -> list[int]:
    """The ids of a word by the same merges as the fold's: always the least rank, the first of equals."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        if 0 <= a and ends[a] < n:
            to = ends[ends[a]]
            found = rank(word[a:to])
            if found is not None:
                heapq.heappush(heap, (found, a, to))

    for a in range(n):
        offer(a)
    while heap:
        _, a, to = heapq.heappop(heap)
        mid = ends[a]
        # Stale if either part has been merged since: a part that is gone has no end.
        if not mid or mid >= n or ends[mid] != to:
            continue
        ends[a], ends[mid] = to, 0
        if to < n:
            before[to] = a
        offer(before[a])
        offer(a)
    ids, a = [], 0
    while a < n:
        ids.append(rank(word[a : ends[a]]))
        a = ends[a]
    return ids


def array_literal(values: np.ndarray) -> Column:
    """A literal array of longs or integers in the layout of Spark's own rows.

    Made of a list, the literal would hold an object for each element, and every text that is made of
    the plan, for logs and listeners, would spell all of them.
    """
    spark = SparkSession.getActiveSession()
    jvm, types = spark._jvm, spark._jvm.org.apache.spark.sql.types
    kind = types.DataTypes.LongType if values.dtype.itemsize == 8 else types.DataTypes.IntegerType
    nulls = bytes(-(-len(values) // 64) * 8)
    data = values.tobytes()
    row = np.int64(len(values)).tobytes() + nulls + data + bytes(-len(data) % 8)
    array = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData()
    array.pointTo(row, jvm.org.apache.spark.unsafe.Platform.BYTE_ARRAY_OFFSET, len(row))
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(array, types.ArrayType(kind, False))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


class PairTable:
    """A literal map from two ids to the id that they merge to: a pair is at one of two places."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        size = max(8, int(len(pairs) * ROOM))
        while (slots := self._placed(pairs, size)) is None:
            size = int(size * 1.1) + 1
        self.size = size
        self.keys = array_literal(np.array([-1 if k is None else k[0] << 16 | k[1] for k in slots], "<i8"))
        self.values = array_literal(np.array([NONE if k is None else pairs[k] for k in slots], "<i4"))

    @staticmethod
    def _places(pair: tuple[int, int], size: int) -> tuple[int, int]:
        a, b = pair
        return (a << 16 | b) % size, (a * 40_503 + b * 9_973) % size

    @classmethod
    def _placed(cls, pairs: dict, size: int) -> list | None:
        slots: list = [None] * size
        for key in pairs:
            at = cls._places(key, size)[0]
            for _ in range(500):
                slots[at], key = key, slots[at]
                if key is None:
                    break
                one, two = cls._places(key, size)
                at = two if at == one else one
            else:
                return None
        return slots

    def bound(self, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
        """``body`` of a lookup (a, b), which gives NONE for pairs that do not merge.

        The literals stand in the expression once, however many lookups the body makes: each
        occurrence would be an array of its own in the plan, in its text and in every task.
        """

        def with_arrays(keys: Column, values: Column) -> Column:
            def get(a: Column, b: Column) -> Column:
                key = a.cast("bigint") * 65_536 + b
                one, two = (key % self.size).cast("int"), ((a.cast("bigint") * 40_503 + b.cast("bigint") * 9_973) % self.size).cast("int")
                return F.when(F.get(keys, one) == key, F.get(values, one)).when(F.get(keys, two) == key, F.get(values, two)).otherwise(F.lit(NONE))

            return body(get)

        return let(self.keys, lambda keys: let(self.values, lambda values: with_arrays(keys, values)))


def _folded(parts: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """The ids that an array of bytes' ids merges to."""

    def start(parts: Column) -> Column:
        n = F.size(parts)
        pairs = F.transform(F.slice(parts, 1, n - 1), lambda a, i: rank(a, F.get(parts, i + 1)))
        merged = F.aggregate(F.sequence(F.lit(1), n - 1), F.struct(parts.alias("parts"), pairs.alias("pairs")), step)
        return F.when(n < 2, parts).otherwise(merged["parts"])

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state["pairs"]), lambda least: F.when(least.isNull() | (least == NONE), state).otherwise(let(F.array_position(state["pairs"], least).cast("int"), lambda p: joined(state, least, p))))

    def joined(state: Column, least: Column, p: Column) -> Column:
        # The merged id is the rank itself; only the pairs on both sides of it change. Passes over
        # these short arrays cost less than cutting and joining them.
        parts, pairs = state["parts"], state["pairs"]
        first, last = p - 2, p
        now = F.transform(pairs, lambda x, i: F.when(i == first, rank(F.get(parts, first), least)).when(i == last, rank(least, F.get(parts, p + 1))).otherwise(x))
        return F.struct(
            F.filter(F.transform(parts, lambda x, i: F.when(i == p - 1, least).otherwise(x)), lambda x, i: i != p).alias("parts"),
            F.filter(now, lambda x, i: i != p - 1).alias("pairs"),
        )

    return let(parts, start)


class WordTable:
    """Words and their 16-bit ids, found by hash and then compared; about 30 bytes a word."""

    def __init__(self, rows: pa.Table | None = None) -> None:
        """Rows have a word, its hash and its ids."""
        words, keys, ids = ((c.combine_chunks() for c in rows.columns) if rows is not None else (pa.array([], t) for t in (pa.binary(), pa.int64(), pa.binary())))
        keys = keys.to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        flat, starts, sizes = _runs(words)
        self.flat, self.starts, self.sizes = flat.copy(), starts[order].astype(np.int32), sizes[order].astype(np.int8)
        flat, starts, sizes = _runs(ids)
        self.ids, self.at, self.n = flat.copy().view("<u2"), (starts[order] // 2).astype(np.int32), (sizes[order] // 2).astype(np.int8)

    def find(self, words: Words, keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Places of the words numbered ``of``, which have these hashes; -1 for words that are not there."""
        if not len(self.keys) or not len(of):
            return np.full(len(of), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        near = np.flatnonzero((self.keys[at] == keys) & (self.sizes[at] == words.sizes[of]))
        equal = near[same(words.flat, words.starts[of[near]], self.flat, self.starts[at[near]].astype(np.int64), words.sizes[of[near]])]
        found = np.full(len(of), -1)
        found[equal] = at[equal]
        return found


class Coded(NamedTuple):
    """Texts as 16-bit ids and marks, where each one's end, and the words that marks stand for."""

    codes: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    word_ends: np.ndarray


class Coder:
    """What a worker needs to code texts with the table's words."""

    def __init__(self, pattern: str, table: WordTable, pieces: list[bytes]) -> None:
        self.split, self.table, self.pieces, self.hashes = splitter(pattern), table, pieces, Hashes()
        self.ranks: dict[bytes, int] = {}

    def long(self, word: bytes) -> np.ndarray:
        if not self.ranks:
            self.ranks.update((p, r) for r, p in enumerate(self.pieces) if p)
        return np.array(heap_merged(word, self.ranks.get), "<u2")

    def distinct(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of different words, a word of each, and the number among these of each word."""
        keys, first, which = np.unique(self.hashes(words.flat, words.starts, words.sizes), return_index=True, return_inverse=True)
        # Words that share a hash with another word than themselves, if any, are numbered by themselves.
        odd = words.sizes != words.sizes[first[which]]
        even = np.flatnonzero(~odd)
        odd[even[~same(words.flat, words.starts[even], words.flat, words.starts[first[which[even]]], words.sizes[even])]] = True
        odd = np.flatnonzero(odd)
        which[odd] = len(keys) + np.arange(len(odd))
        return np.concatenate([keys, np.zeros(len(odd), np.uint64)]), np.concatenate([first, odd]), which

    def code(self, texts: list[str], number: int = 0) -> Coded:
        """Marks are numbered within each text, from ``number`` on."""
        words = self.split(texts)
        keys, first, which = self.distinct(words)
        at = self.table.find(words, keys, first)
        known = np.flatnonzero(at >= 0)
        starts, sizes = np.full(len(first), -1), np.zeros(len(first), np.int64)
        sizes[known] = self.table.n[at[known]]  # 40 ids at most
        starts[known] = np.cumsum(sizes[known]) - sizes[known]
        flat = [gathered(self.table.ids, self.table.at[at[known]].astype(np.int64), sizes[known])]
        room = len(flat[0])
        for k in np.flatnonzero((at < 0) & (words.sizes[first] > LONG_BYTES)).tolist():
            a = words.starts[first[k]]
            flat.append(self.long(words.flat[a : a + words.sizes[first[k]]].tobytes()))
            starts[k], sizes[k] = room, len(flat[-1])
            room += len(flat[-1])
        # One mark for each different word that a text has and the table has not.
        starts, sizes = starts[which], sizes[which]
        lacking = np.flatnonzero(starts < 0)
        texts_of = np.searchsorted(words.cuts, lacking, "right") - 1
        marks, one, mark = np.unique(texts_of * len(first) + which[lacking], return_index=True, return_inverse=True)
        word_ends = np.searchsorted(marks, np.arange(1, len(texts) + 1) * len(first))
        numbers = number + np.arange(len(marks)) - np.append(0, word_ends)[texts_of[one]]
        flat.append(np.column_stack([np.full(len(marks), MARK), numbers // MARK, numbers % MARK]).astype("<u2").reshape(-1))
        starts[lacking], sizes[lacking] = room + 3 * mark, 3
        of = lacking[one]
        ends = np.append(0, np.cumsum(sizes))[words.cuts[1:]]
        return Coded(gathered(np.concatenate(flat), starts, sizes), ends, gathered(words.flat, words.starts[of], words.sizes[of]), words.sizes[of], word_ends)

    def code_all(self, texts: list[str]) -> Coded:
        parts: list[Coded] = []
        for run, long in runs(texts):
            if long:
                of_one: list[Coded] = []
                for piece in run:
                    of_one.append(self.code([piece], sum(len(c.sizes) for c in of_one)))
                joined = [np.concatenate(x) for x in zip(*of_one, strict=True)]
                parts.append(Coded(joined[0], np.array([len(joined[0])]), joined[2], joined[3], np.array([len(joined[3])])))
            else:
                parts.append(self.code(run))
        shifts = np.cumsum([0, *(len(c.codes) for c in parts)]), np.cumsum([0, *(len(c.sizes) for c in parts)])
        return Coded(
            np.concatenate([c.codes for c in parts]), np.concatenate([c.ends + s for c, s in zip(parts, shifts[0], strict=False)]),
            np.concatenate([c.words for c in parts]), np.concatenate([c.sizes for c in parts]),
            np.concatenate([c.word_ends + s for c, s in zip(parts, shifts[1], strict=False)]),
        )


class WordCounts:
    """How often a worker has met each word of ``TABLE_BYTES`` bytes at most; words of equal hashes are counted as one."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, coder: Coder, words: Words) -> None:
        keys, first, which = coder.distinct(words)
        short = np.flatnonzero(words.sizes[first] <= TABLE_BYTES)
        at, sizes = words.starts[first[short]], words.sizes[first[short]]
        self.parts.append((keys[short], np.bincount(which, minlength=len(first))[short], sizes, gathered(words.flat, at, sizes)))
        self.held += len(short)

    def full(self) -> bool:
        """Whether there is enough to be handed on, once what is held has been put together."""
        if self.held > 4 * HELD:
            self._together()
            return self.held > HELD
        return False

    def _together(self) -> None:
        keys, times, sizes, flat = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        found, first, which = np.unique(keys, return_index=True, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        self.parts = [(found, np.bincount(which, weights=times).astype(np.int64), sizes[first], gathered(flat, starts[first], sizes[first]))]
        self.held = len(found)

    def taken(self) -> pa.RecordBatch:
        self._together()
        _, times, sizes, flat = self.parts[0]
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([_binary(flat, sizes), pa.array(times)], names=["word", "n"])


class Encoder:
    """Encodes and decodes by one rank file and pattern; ``learn_words`` fills its table."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> None:
        if max(ranks.values()) >= MARK:
            raise ValueError("ids have to fit in 16 bits")
        self.spark, self.pattern = spark, pattern
        # Two workers of a task and the JVM hold a batch each, of whole texts: fewer rows than Spark's default bound that.
        if not 0 < int(spark.conf.get(BATCH_ROWS)) <= ROWS:
            spark.conf.set(BATCH_ROWS, str(ROWS))
        get = ranks.get
        splits = (((get(t[:i]), get(t[i:])), r) for t, r in ranks.items() for i in range(1, len(t)))
        self.pairs = PairTable({pair: r for pair, r in splits if None not in pair})
        gc.collect()
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        by_rank = {r: t for t, r in ranks.items()}
        self.pieces = [by_rank.get(r, b"") for r in range(max(by_rank) + 1)]
        self.table = WordTable()

    def fold(self, words: Column) -> Column:
        """Ids for each of an array of words, which are arrays of their bytes' ids."""
        return self.pairs.bound(lambda rank: F.transform(words, lambda w: _folded(w, rank)))

    def learn_words(self, docs: DataFrame, text: str = "text") -> None:
        pattern, codes = self.pattern, self.bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, counts = Coder(pattern, WordTable(), []), WordCounts()
            for batch in sliced(batches):
                for together, _ in runs([t.as_py() or "" for t in batch.column(0)]):
                    counts.add(coder, coder.split(together))
                    if counts.full():
                        yield counts.taken()
            if counts.parts:
                yield counts.taken()

        texts = docs.select(F.col(text).cast("string").alias("text"))
        counted = texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
        counted = written(counted.withColumn("bin", F.floor(F.log2("n") * 32).cast("int")), "words")
        # A histogram of counts, 32 bins to a doubling, tells down to which count the table has room.
        least, room = None, TABLE_WORDS
        for r in sorted(counted.groupBy("bin").count().collect(), reverse=True):
            if r["count"] > room:
                break
            least, room = r["bin"], room - r["count"]
        common = counted.filter(F.col("bin") >= least if least is not None else F.lit(False)).select("word")

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spelling = np.array(codes, np.int32)
            for batch in batches:
                flat, _, sizes = _runs(batch.column(0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(_edges(sizes), pa.array(spelling[flat]))], names=["word", "parts"])

        spelt = common.repartition(4 * self.spark.sparkContext.defaultParallelism).mapInArrow(spell, "word binary, parts array<int>")
        folded = spelt.select("word", F.get(self.fold(F.array("parts")), F.lit(0)).alias("ids"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                keys = hashes(*_runs(batch.column(0))).view(np.int64)
                ids = batch.column(1)
                edges = ids.offsets.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), _binary(ids.values.to_numpy()[edges[0] : edges[-1]].astype("<u2"), 2 * np.diff(edges))], names=["word", "key", "ids"])

        # TABLE_WORDS rows at most, about 28 bytes each.
        self.table = WordTable(folded.mapInArrow(packed, "word binary, key bigint, ids binary").toArrow())
        dropped(counted)
        pa.default_memory_pool().release_unused()

    def encode(self, docs: DataFrame, columns: list[str], text: str = "text", with_ids: bool = True) -> DataFrame:
        """``columns``, then ids (array, if wanted), n_tokens, ids_sha256 and decoded_sha256."""
        coded = self._coded(docs, columns, text)
        folded = coded.select("keep", "coded", F.when(F.size("others") > 0, self.fold(F.col("others"))).otherwise(F.array().cast("array<array<int>>")).alias("others"))
        return self._digested(folded, columns, with_ids)

    def _coded(self, docs: DataFrame, columns: list[str], text: str) -> DataFrame:
        """keep (the columns), coded (16-bit ids and marks), others (spelt distinct words)."""
        kept = docs.select(F.struct(*[F.col(c) for c in columns]).alias("keep"), F.col(text).cast("string").alias("text"))
        shared = self.spark.sparkContext.broadcast((self.pattern, self.table, self.pieces, np.array(self.bytes, np.int32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *parts, spelling = shared.value
            coder = Coder(*parts)
            for batch in sliced(batches):
                if batch.num_rows:
                    made = coder.code_all([t.as_py() or "" for t in batch.column(1)])
                    spelt = pa.ListArray.from_arrays(_edges(made.sizes), pa.array(spelling[made.words]))
                    others = pa.ListArray.from_arrays(pa.array(np.append(0, made.word_ends), pa.int32()), spelt)
                    yield pa.RecordBatch.from_arrays([batch.column(0), _binary(made.codes, 2 * np.diff(made.ends, prepend=0)), others], names=["keep", "coded", "others"])

        return kept.mapInArrow(run, f"keep {kept.schema['keep'].dataType.simpleString()}, coded binary, others array<array<int>>")

    def _digested(self, folded: DataFrame, columns: list[str], with_ids: bool) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.pieces)
        kept = folded.schema["keep"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = Strings(shared.value)
            names = Strings([b"%d " % i for i in range(len(shared.value))])
            for batch in weighed(batches, 1):
                ids, ends = merged(batch.column(1), batch.column(2))
                cuts = [0, *ends.tolist()]
                texts, spelt = pieces.joined(ids), names.joined(ids)
                # Where each document's bytes end: at the sum of its ids' lengths.
                text_cuts, name_cuts = ([0, *np.append(0, np.cumsum(of.sizes.take(ids), dtype=np.int64))[ends].tolist()] for of in (pieces, names))
                hashes = [hashlib.sha256(spelt[a : max(a, b - 1)]).hexdigest() for a, b in zip(name_cuts[:-1], name_cuts[1:], strict=True)]
                decoded = [hashlib.sha256(texts[a:b]).hexdigest() for a, b in zip(text_cuts[:-1], text_cuts[1:], strict=True)]
                made = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array(np.diff(cuts), pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["keep", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

        out = folded.mapInArrow(run, f"keep {kept}, {'ids array<int>, ' if with_ids else ''}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
        return out.select(*[F.col("keep").getField(c).alias(c) for c in columns], *out.columns[1:])


def _edges(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)), pa.int32())


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of these sizes, cut from an array."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, _edges(sizes).buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def _runs(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column's bytes, and where in them each value starts and how many it has."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, edges[:-1] - edges[0], np.diff(edges)


def merged(coded: pa.BinaryArray, others: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of documents, one behind the other, with folded words in their marks' places; and where each one's end."""
    flat, starts, sizes = _runs(coded)
    codes, ends = flat.view("<u2"), (starts + sizes) // 2
    words = others.values
    values, word_edges = words.values.to_numpy().astype("<u2"), words.offsets.to_numpy().astype(np.int64)
    marks = np.flatnonzero(codes == MARK)
    if not len(marks):
        return codes, ends
    # The two numbers behind a mark are digits to the base MARK, so neither is a mark.
    owner = np.searchsorted(ends, marks, "right")
    word = others.offsets.to_numpy().astype(np.int64)[owner] + codes[marks + 1].astype(np.int64) * MARK + codes[marks + 2]
    starts, sizes = np.arange(len(codes)), np.ones(len(codes), np.int64)
    starts[marks], sizes[marks] = len(codes) + word_edges[word], word_edges[word + 1] - word_edges[word]
    sizes[marks + 1] = sizes[marks + 2] = 0
    return gathered(np.concatenate([codes, values]), starts, sizes), np.append(0, np.cumsum(sizes))[ends]


def encode_documents(docs: DataFrame, columns: list[str], path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``columns`` of each document with its ids and their digests."""
    encoder = Encoder(docs.sparkSession, load_ranks(path), pattern)
    encoder.learn_words(docs)
    return encoder.encode(docs, columns, with_ids=with_ids)


def op9_byte_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, ["doc_id"], tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
