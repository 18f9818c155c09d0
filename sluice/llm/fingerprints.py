"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every five-word shingle is hashed once. The hash's top bits name its bin, the least hash of a bin
is the bin's value, an empty bin takes the value of a full bin chosen by a hash of both bin numbers
(optimal densification: the choice is the same in every document with the same full bins), and
only the low bits of each value are stored. Agreement by chance of such bits is taken off again
when two fingerprints are compared.

Defined results: null text counts as empty; a text of one to four words is one shingle; a text
without words has the fingerprint ``""``, which is like itself (1.0) and unlike any other (0.0).
Columns other than those named are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, n_partitions, present, words

SHINGLE_WORDS = 5
#: Bins (a power of two), the bits kept of each, and a prime not below the number of bins.
BIN_BITS, LOW_BITS, PRIME = 7, 8, 131
BINS = 1 << BIN_BITS
MASK = (1 << LOW_BITS) - 1
DIGITS = LOW_BITS // 4


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """A 64-bit hash of each shingle, repeats included."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n <= width, F.array(F.xxhash64(hashes)))
            .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, width))))
        )

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def _least_of_bins(hashes: Column) -> Column:
    """One hash for each full bin: sorting brings a bin's hashes together, least first."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))


def _donor(full: Column, i: Column) -> Column:
    """Low bits of the full bin that stands first in bin i's own order of all bins."""
    step, start = F.pmod(i * 37 + 11, F.lit(PRIME - 1)) + 1, F.pmod(i * 53 + 29, F.lit(PRIME))
    ranked = F.transform(full, lambda h: F.pmod(step * (_bin(h) + 1) + start, F.lit(PRIME)) * (MASK + 1) + h.bitwiseAND(F.lit(MASK)))
    return F.array_min(ranked).bitwiseAND(F.lit(MASK))


def fingerprint(text: Column) -> Column:
    """The packed bins in hexadecimal, two digits a bin; ``""`` for a text without words."""
    digits = F.array(*[F.lit(f"{v:0{DIGITS}x}") for v in range(MASK + 1)])

    def packed(full: Column, bins: Column) -> Column:
        def one(i: Column) -> Column:
            return let(F.array_position(bins, i), lambda at: F.when(at > 0, F.get(full, at.cast("int") - 1).bitwiseAND(F.lit(MASK))).otherwise(_donor(full, i)))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), lambda i: F.get(digits, one(i).cast("int"))), "")

    return let(
        _least_of_bins(shingle_hashes(text)),
        lambda full: F.when(F.size(full) == 0, F.lit("")).otherwise(let(F.transform(full, _bin), lambda bins: packed(full, bins))),
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, i * DIGITS + 1, F.lit(DIGITS))))
    chance = 1.0 / (MASK + 1)
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1.0 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(corrected)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the key, by binary search in a literal array."""
    steps = max(1, len(bounds).bit_length())
    top = (1 << 63) - 1
    padded = F.array(*[F.lit(b).cast("bigint") for b in bounds + [top] * ((1 << steps) - len(bounds))])
    powers = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), lambda at, p: F.when(F.get(padded, at + p - 1) <= key, at + p).otherwise(at))


def with_next(docs: DataFrame, key: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Each row with the ``columns`` of its successor as ``next_<column>``, by descending ``key``.

    The last row's successor is the first row. Rows are dealt to buckets of the key by
    quantiles, so that no task sorts all rows; a bucket's end gets a copy of the next bucket's
    first row. Null keys come last; rows of equal key are ordered by the hash of ``columns``.
    ``derived`` columns are computed once a row, before the successor is looked up.
    """
    derived = derived or {}
    spark = docs.sparkSession
    low = -(1 << 63)
    at = F.coalesce(F.col(key).cast("bigint"), F.lit(low))
    rows = docs.select(key, *columns, at.alias("_at"), F.xxhash64(*columns).alias("_tie"))
    n = 2 * n_partitions(spark)
    cuts = rows.select(F.percentile_approx("_at", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    rows = rows.withColumn("_bucket", _bucket(F.col("_at"), bounds))
    # One row a bucket, so at most as many as there are buckets: where each bucket starts.
    starts = sorted((r[0], r[1], r[2]) for r in rows.groupBy("_bucket").agg(F.max_by(F.struct("_at", "_tie"), F.struct("_at", (-F.col("_tie").cast("decimal(20,0)")).alias("t"))).alias("s")).select("_bucket", "s._at", "s._tie").collect())
    if not starts:
        made = docs.select(key, *columns).withColumns(derived)
        return made.select("*", *[F.col(c).alias(f"next_{c}") for c in [*columns, *derived]])
    before = [(a, t, starts[(i + 1) % len(starts)][0]) for i, (_, a, t) in enumerate(starts)]
    ends = F.broadcast(spark.createDataFrame(before, "_at bigint, _tie bigint, _to int"))
    heads = rows.join(ends, ["_at", "_tie"]).drop("_bucket").withColumnRenamed("_to", "_bucket").dropDuplicates(["_bucket"])
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True))).withColumns(derived)
    columns = [*columns, *derived]
    order = Window.partitionBy("_bucket").orderBy("_head", F.col("_at").desc(), "_tie")
    return both.select(key, *columns, "_head", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter(~F.col("_head")).drop("_head")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose last half the next document's start replaces."""
    base = docs.select(F.col("doc_id"), present(F.col("text")).alias("text"))
    base = with_next(base, "doc_id", ["text"], {"fingerprint": fingerprint(F.col("text"))})
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = base.select("*", n.cast("bigint").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    return edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
