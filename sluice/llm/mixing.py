"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Targets: sources weigh by their place in code-point order and share a part of all words; none gets
more than ``most`` times its size, and what it leaves goes to the others by weight. Blocks: the
targets are turned into whole blocks of equal word counts by highest quotients (target / (2k + 1)),
first over sources, then within a source over ranges of ``RANGE`` shards, then within a range over its
shards, so that no task ranks more than a range or the ranges of one source. A source has a shard for
each ``shard_words`` of its own words, so a shard's share is many blocks; documents are dealt to shards
by a hash. Blocks that a shard cannot hold ``most`` times are dealt again over its range. Selection: a
shard's documents are put in a seeded order and cut into equal blocks; full passes take every block,
and the rest of the quota takes blocks at even steps from a seeded start. Small sources are cut
``FINE`` times finer. What a document gives is what its word span shares with the taken blocks.

Defined results: null, empty and blank texts have no words and give none; very long texts may fill many
blocks; sources may be null (last, one group of their own); sources without words have target 0; with
no rows there is no result. Rows of equal id stand next to each other by size. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, let, present, small, words, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS, SEED = 128, 65_536, 20250101
#: Shards of a range; how much finer a source of fewer than SMALL blocks is cut.
RANGE, FINE, SMALL = 1024, 16, 256


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with the target of each source; one row a source.

    The level at which ``weight * level`` sums to the shared words once capped is found by taking
    sources in the order of the level at which each reaches its cap.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rows = sizes.withColumn("_place", F.row_number().over(place) - 1)
    rows = rows.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("_place", F.lit(len(weights)))))
    rows = rows.withColumn("_cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), "_place")
    everything = Window.partitionBy()
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_total": share * F.sum("source_size").over(everything),
        "_full": F.coalesce(F.sum("_cap").over(below), F.lit(0.0)),
        "_open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)),
    })
    # If a source and all after it stayed below their caps, the level would be this.
    rows = rows.withColumn("_level", F.greatest(F.col("_total") - F.col("_full"), F.lit(0.0)) / F.col("_open"))
    rows = rows.withColumn("_free", F.col("_level") * F.col("weight") < F.col("_cap"))
    level = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), "_place", "_level"))).over(everything)["_level"]
    rows = rows.withColumn("target", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("weight"))).cast("double"))
    return rows.select("source", "source_size", "weight", "target")


def sainte_lague(rows: DataFrame, claim: str, blocks: str, group: list[str], out: str, order: list[Column]) -> DataFrame:
    """Deals ``blocks`` (equal within a group) whole blocks to the rows by highest quotients.

    The quotients above a divisor that is surely too high are granted at once; only those down to
    a divisor that is surely too low, at most about three a row, are ranked. Ties go by ``order``.
    """
    all_of = Window.partitionBy(*group)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(all_of), "_sum": F.sum(claim).over(all_of), "_row": F.row_number().over(all_of.orderBy(*order))})

    def whole(divisor: Column) -> Column:
        return F.when(divisor > 0, F.floor(F.col(claim) / divisor + 0.5)).otherwise(F.lit(0)).cast("bigint")

    sure = F.when(F.col(blocks) > F.col("_n"), F.greatest(whole(F.col("_sum") / (F.col(blocks) - F.col("_n"))) - 1, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    last = F.when(F.col("_sum") > 0, whole(F.col("_sum") / (F.col(blocks) + F.col("_n"))) + 1).otherwise(F.lit(0).cast("bigint"))
    rows = rows.withColumns({"_sure": sure, "_last": last})
    rows = rows.withColumn("_left", F.col(blocks) - F.sum("_sure").over(all_of))
    open_ = rows.filter("_last > _sure").select(*group, "_row", "_left", claim, F.explode(F.sequence("_sure", F.col("_last") - 1)).alias("_k"))
    ranked = open_.withColumn("_at", F.row_number().over(all_of.orderBy((F.col(claim) / (2 * F.col("_k") + 1)).desc(), "_row", "_k")))
    won = ranked.filter("_at <= _left").groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_row").alias("_r")).agg(F.count(F.lit(1)).alias("_won"))
    same = F.col("_row") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    got = rows.join(won, same, "left")
    return got.withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_n", "_sum", "_row", "_sure", "_last", "_left", "_r", "_won", *[f"_g{i}" for i in range(len(group))])


def _taken_before(at: Column, size: Column, n_blocks: Column, quota: Column, start: Column) -> Column:
    """Words taken from a shard's first ``at`` words, the shard being cut into equal blocks.

    Block widths are the fraction size / n_blocks; all is counted in n_blocks-ths of a word.
    """
    extra = F.pmod(quota, n_blocks)

    def chosen(j: Column) -> Column:  # of the first j blocks, by even steps from a seeded start
        return F.floor((j + start) * extra / n_blocks) - F.floor(start * extra / n_blocks)

    def within(j: Column) -> Column:
        part = (at * n_blocks - j * size) * (chosen(j + 1) - chosen(j))
        return F.floor(quota / n_blocks) * at + F.floor((chosen(j) * size + part) / n_blocks)

    return F.when(size <= 0, F.lit(0).cast("bigint")).otherwise(let(F.floor(at * n_blocks / F.greatest(size, F.lit(1))), within))


def _sized(docs: DataFrame, more: list[Column]) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", F.size(words(text)).cast("bigint").alias("size"), F.xxhash64(text).alias("_tie"), *more)


def _quotas(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, block_words: int, shard_words: int) -> DataFrame:
    """(_source, source_size, target, source_blocks, fine, n_shards): one row a source."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    total = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("bigint")
    quotas = sainte_lague(targets.withColumn("_blocks", total), "target", "_blocks", [], "source_blocks", [F.col("source").isNull(), F.col("source").cast("binary")])
    fine = F.when(F.col("source_size") < SMALL * block_words, F.lit(FINE)).otherwise(F.lit(1)).cast("bigint")
    shards = F.greatest(F.lit(1), F.floor(F.col("source_size") / shard_words)).cast("bigint")
    return quotas.select(F.col("source").alias("_source"), "source_size", "target", "source_blocks", fine.alias("fine"), shards.alias("n_shards"))


def _dealt(sized: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """Documents with their source's quota and their shard."""
    rows = sized.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_tie"), F.col("n_shards")))


def _cells(dealt: DataFrame, most: float, block_words: int) -> DataFrame:
    """(_source, _shard, cell_size, n_blocks, quota): the shards that have rows."""
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_blocks").alias("source_blocks"), F.first("fine").alias("fine"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    cells = written(cells.withColumn("range", F.floor(F.col("shard") / RANGE)), "cells")
    ranges = cells.groupBy("source", "range").agg(F.sum("cell_size").cast("double").alias("_claim"), (F.first("source_blocks") * F.first("fine")).alias("_blocks"))
    ranges = sainte_lague(ranges, "_claim", "_blocks", ["source"], "range_blocks", [F.col("range")])
    ranges = ranges.select(F.col("source").alias("_s"), F.col("range").alias("_r"), "range_blocks")
    cells = cells.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).drop("_s", "_r")
    cells = sainte_lague(cells.withColumn("_claim", F.col("cell_size").cast("double")), "_claim", "range_blocks", ["source", "range"], "_quota", [F.col("shard")])
    cells = cells.withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("cell_size") * F.col("fine") / block_words)).cast("bigint"))
    # A source whose target is its cap gives all it may; elsewhere what is too much for a shard goes to the others of its range.
    room = (F.lit(most) * F.col("n_blocks")).cast("bigint")
    cells = cells.withColumn("_held", F.when(F.col("target") >= most * F.col("source_size"), room).otherwise(F.least("_quota", room)))
    whole = Window.partitionBy("source", "range")
    cells = cells.withColumn("_over", F.greatest(F.sum(F.col("_quota") - F.col("_held")).over(whole), F.lit(0)))
    cells = cells.withColumn("_slack", (room - F.col("_held")).cast("double"))
    cells = cells.withColumn("_over", F.least("_over", F.sum("_slack").over(whole).cast("bigint")))
    cells = sainte_lague(cells, "_slack", "_over", ["source", "range"], "_more", [F.col("shard")])
    return cells.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell_size", "n_blocks", F.least(F.col("_held") + F.col("_more"), room).alias("quota"))


def _spans(docs: DataFrame, more: list[Column], weights: tuple[float, ...], share: float, most: float, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """Each document with its shard's cut and quota, and the end of its words in the shard's order."""
    # Words are counted once, in a table without texts; where documents are wanted whole, they are counted again beside them.
    sized = written(_sized(docs, []), "sizes")
    quotas = small(written(_quotas(sized, weights, share, most, block_words, shard_words), "quotas"), 128)
    cells = _cells(_dealt(sized, quotas, seed), most, block_words)
    rows = _dealt(_sized(docs, more) if more else sized, quotas, seed)
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "_tie")
    spans = rows.withColumn("_end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.join(small(written(cells, "quotas"), 64), (F.col("shard") == F.col("_shard")) & F.col("source").eqNullSafe(F.col("_source")))
    return spans.withColumn("_start", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("n_blocks")))


def _before(at: Column) -> Column:
    return _taken_before(at, F.col("cell_size"), F.col("n_blocks"), F.col("quota"), F.col("_start"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shard; one row a document."""
    spans = _spans(docs, [], weights, share, most, block_words, shard_words, seed)
    return spans.select("doc_id", "source", "size", "source_size", "target", (_before(F.col("_end")) - _before(F.col("_end") - F.col("size"))).alias("taken"), "shard")


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time that words of a document are taken.

    A row's text is the document's, or, where taken blocks end within it, the taken words with the
    white space after each; n_chars is brought up to date. The rows' words add up to ``taken``.
    """
    spans = _spans(docs, [F.struct("*").alias("row")], weights, share, most, block_words, shard_words, seed)
    first = F.col("_end") - F.col("size")
    pieces = F.regexp_extract_all(present(F.col("row.text")), F.lit(f"{WORD_RE}[\\x20\\x09-\\x0D]*"), F.lit(0))
    # Taken words before each word and after the last: the differences say how often each is taken.
    before = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("size")), lambda i: _before(first + i))
    rows = spans.withColumn("_taken", _before(F.col("_end")) - _before(first)).filter("_taken > 0")
    rows = rows.withColumn("_whole", F.floor(F.col("_taken") / F.col("size")))
    rows = rows.withColumn("_even", F.col("_taken") == F.col("_whole") * F.col("size"))
    # Uneven: some blocks within the document are taken once more than the others.
    most_times = -int(-most // 1)

    def parts(pair: Column) -> Column:
        ws, marks = pair["ws"], pair["marks"]

        def taken(k: int) -> Column:
            return let(F.filter(ws, lambda w, i: F.get(marks, i + 1) - F.get(marks, i) >= k), lambda p: F.when(F.size(p) == F.size(ws), F.col("row.text")).otherwise(F.array_join(p, "")))

        return F.filter(F.array(*[taken(k) for k in range(1, most_times + 1)]), lambda t: t != "")

    texts = F.when(F.col("_even"), F.array_repeat(F.col("row.text"), F.col("_whole").cast("int"))).otherwise(let(F.struct(pieces.alias("ws"), before.alias("marks")), parts))
    out = rows.select("row", F.explode(texts).alias("_text"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("_text").alias(name)
        if name == "n_chars":
            return F.when(F.col("_text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.char_length("_text")).cast(docs.schema[name].dataType).alias(name)
        return F.col("row").getField(name).alias(name)

    return out.select(*[column(c) for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express: sizes and targets."""
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))
