"""Line dedup within one edit by a deletion-neighbourhood join, with DataFrame functions only.

A line is dropped if an earlier line, by (doc_id, place in the text), is equal to it or, for lines
of ``MIN_CHARS`` code points or more, is within one insertion, deletion or substitution of it. The
earlier line counts whether or not it is dropped itself, so the outcome does not depend on any
order of work.

Two lines within one edit share a deletion variant: without the edited character they are equal
(substitution), or the longer one without it equals the shorter (insertion). Emitting all variants
of all lines costs a row for each character, so the neighbourhood is entered in three steps that
lose nothing. A gap key is a line without a stretch of characters: lines within one edit share the
key of whichever stretch holds the edit. Step one uses two stretches a line, step two cuts the
stretches of lines that shared a key into about the root of their length, and only the last step,
for stretches that still have company, emits the variants of every single character. Lines in
company at the last step are one edit apart up to collisions of hashes; levenshtein verifies each
against the earliest of its company.

A substitution variant names its place, so all its lines are within one edit of each other; an
insertion variant ties longer lines to the one shorter line. Either way a line is held against the
earliest of its company only, and a group of n lines gives n rows.

Defined results: null text has no lines; lines without a word are never dropped; a text whose lines
are all kept stays as it is. Repeated rows with one id are ordered by text and stay separate rows
with the same lines dropped only if a row before them has them. Extra columns pass through
``dedup_documents`` unchanged whatever their names, packed in a struct meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, dropped, present, small, written

MIN_CHARS = 16


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, at, line) of the lines that hold a word; at counts all lines from 0."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.posexplode(F.split(present(F.col("text")), "\n", -1)).alias("at", "line"))
    return rows.filter(F.col("line").rlike(WORD_RE))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie", "at")


def _gap_key(line: Column, n: Column, role: Column, a: Column, b: Column) -> Column:
    """Hash of a line of base length n without the stretch [a, b); role 1 lines are one longer there."""
    return F.xxhash64(n, a, b, F.substring(line, F.lit(1), a), F.substring(line, b + role + 1, n - b))


def _roles(n: Column) -> Column:
    """A line takes part as the base of its own length, and as a longer partner of bases one shorter."""
    return F.explode(F.array(F.struct(F.lit(0).alias("role"), n.alias("n")), F.struct(F.lit(1).alias("role"), (n - 1).alias("n"))))


def _in_company(keyed: DataFrame) -> DataFrame:
    """The keys that two or more lines share, at least one of them in the base role."""
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("role").alias("base"))
    return shared.filter("lo <> hi and base = 0").select("key")


def _stretches(pieces: Column, a: Column, b: Column) -> Column:
    """[a, b) cut into that many pieces, as an array of structs a, b; none for an empty stretch."""
    cut = lambda k: a + F.floor((b - a) * k / pieces).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: F.struct(cut(k).alias("a"), cut(k + 1).alias("b"))), lambda s: (s["a"] < s["b"]) | (a == b))


def exact_lines(docs: DataFrame) -> DataFrame:
    """One row for each different line: its 128-bit id, its first place, its length and step-one keys."""
    lines = document_lines(docs)
    n = F.char_length("line")
    halves = lambda role, m: [_gap_key(F.col("line"), m, F.lit(role), a, b) for a, b in ((F.lit(0), F.floor(m / 2).cast("int")), (F.floor(m / 2).cast("int"), m))]
    keys = F.when(n >= MIN_CHARS, F.array(*halves(0, n), *halves(1, n - 1)))
    return lines.select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"), _order().alias("first"), keys.alias("keys")).groupBy("id").agg(F.min("first").alias("first"), F.first("keys").alias("keys"))


def near_lines(docs: DataFrame, exact: DataFrame) -> DataFrame:
    """(id, earlier): lines that have an earlier line within one edit; ``exact`` is written ``exact_lines``."""
    keyed = exact.filter("keys is not null").select("id", F.posexplode("keys").alias("k", "key")).select("id", "key", (F.col("k") >= 2).cast("int").alias("role"))
    company = keyed.join(_in_company(keyed), "key", "left_semi").select("id").distinct()
    some = written(company.join(exact.select("id", "first"), "id").select("id", "first.*"), "company")
    # The texts of these lines: from the documents again, joined by place.
    wanted = some.groupBy("doc_id", "tie").agg(F.collect_list("at").alias("ats")).select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "ats")
    text = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").join(small(written(wanted, "wanted"), 64), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")))
    text = text.select("doc_id", "tie", F.explode("ats").alias("at"), F.split("text", "\n", -1).alias("ls")).select("doc_id", "tie", "at", F.get("ls", F.col("at")).alias("line"))
    lines = text.select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"), _order().alias("first"), "line").dropDuplicates(["id"])
    lines = written(lines, "lines")
    # Step two and three: keys of ever smaller stretches, for lines with company only.
    start = lines.select("id", "first", "line", _roles(F.char_length("line")).alias("r")).select("id", "first", "line", "r.role", "r.n")
    whole = start.select("*", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.floor(F.col("n") / 2).cast("int").alias("b")), F.struct(F.floor(F.col("n") / 2).cast("int").alias("a"), F.col("n").alias("b")))).alias("s"))
    pieces = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("s.b") - F.col("s.a")).cast("double"))).cast("int"))
    fine = whole.select("id", "role", "n", "first", "line", F.explode(_stretches(pieces, F.col("s.a"), F.col("s.b"))).alias("s")).select("id", "role", "n", "line", "first", "s.a", "s.b")
    fine = fine.withColumn("key", _gap_key(F.col("line"), F.col("n"), F.col("role"), F.col("a"), F.col("b")))
    places = fine.select("key", "id", "role", "n", "a", "b")
    close = written(places.join(_in_company(places), "key", "left_semi").drop("key"), "close")
    variants = written(_variants(close.join(lines, "id")), "variants")
    found = _earliest(variants)
    names = found.join(lines.select("id", "line"), "id").join(lines.select(F.col("id").alias("earlier"), F.col("line").alias("other")), "earlier")
    near = names.filter((F.abs(F.char_length("line") - F.char_length("other")) <= 1) & (F.levenshtein("line", "other", 1) == 1)).select("id", "earlier")
    return near


def _variants(close: DataFrame) -> DataFrame:
    """(key, kind, id, first): every deletion variant of a line within its stretches.

    kind 0: a substitution variant, with its place; kind 1: the whole base line; kind 2: a longer
    line without one character.
    """
    n, a, b, role = F.col("n"), F.col("a"), F.col("b"), F.col("role")
    cut = lambda p: F.concat(F.substring(F.col("line"), F.lit(1), p), F.substring(F.col("line"), p + 2, n))
    swaps = F.transform(F.sequence(a, b - 1), lambda p: F.struct(F.xxhash64(F.lit(0), n, p, cut(p)).alias("key"), F.lit(0).alias("kind")))
    whole = F.array(F.struct(F.xxhash64(F.lit(1), n, F.col("line")).alias("key"), F.lit(1).alias("kind")))
    without = F.transform(F.sequence(a, b), lambda p: F.struct(F.xxhash64(F.lit(1), n, cut(p)).alias("key"), F.lit(2).alias("kind")))
    base = F.when(a < b, F.concat(swaps, whole)).otherwise(whole)
    made = close.select("id", "first", F.explode(F.when(role == 0, base).otherwise(without)).alias("v")).select("v.key", "v.kind", "id", "first")
    return made.distinct()


def _earliest(variants: DataFrame) -> DataFrame:
    """(id, earlier): each line with the earliest line of each company it is in, if that is earlier."""
    mark = F.struct("first", "id")
    swap = variants.filter("kind = 0").groupBy("key").agg(F.min(mark).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("k"), F.lit(0).alias("of"), "m")
    base = variants.filter("kind = 1").groupBy("key").agg(F.min(mark).alias("m")).select(F.col("key").alias("k"), F.lit(2).alias("of"), "m")
    longer = variants.filter("kind = 2").groupBy("key").agg(F.min(mark).alias("m")).select(F.col("key").alias("k"), F.lit(1).alias("of"), "m")
    best = swap.union(base).union(longer)
    joined = variants.join(best, (F.col("key") == F.col("k")) & (F.col("kind") == F.col("of")))
    return joined.filter(F.col("m.first") < F.col("first")).select("id", F.col("m.id").alias("earlier")).distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, at, near): every dropped line; near says that no earlier line equals it."""
    exact = written(exact_lines(docs), "exact")
    near = written(near_lines(docs, exact).select("id").distinct(), "near")
    lines = document_lines(docs).select("doc_id", "tie", "at", F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"), _order().alias("me"))
    known = exact.select(F.col("id").alias("_id"), "first").join(near.select(F.col("id").alias("_near")), F.col("_id") == F.col("_near"), "left")
    held = lines.join(known, F.col("id") == F.col("_id"))
    return held.filter((F.col("first") < F.col("me")) | F.col("_near").isNotNull()).select("doc_id", "tie", "at", (F.col("first") == F.col("me")).alias("near")).distinct()


def dedup_documents(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the kept lines as ``text``; with n_chars brought up to date.

    Documents that lose every line that holds a word are left out; those without any stay.
    """
    lost = dropped_lines(docs).groupBy("doc_id", "tie").agg(F.collect_set("at").alias("ats"))
    lost = small(written(lost.select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "ats"), "lost"), 96)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_tie"))
    rows = rows.join(lost, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t")), "left")
    kept = F.filter(F.split(F.col("row.text"), "\n", -1), lambda line, i: ~F.array_contains(F.col("ats"), i))
    text = F.when(F.col("ats").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.withColumn("_text", text).filter(F.col("ats").isNull() | F.col("_text").rlike(WORD_RE))
    return rows.select(*[_column(c, docs) for c in docs.columns])


def _column(name: str, docs: DataFrame) -> Column:
    if name == "text":
        return F.col("_text").alias("text")
    if name == "n_chars":
        return F.when(F.col("ats").isNull(), F.col("row.n_chars")).otherwise(F.char_length("_text")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return F.col("row").getField(name).alias(name)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every dropped line: its document, its place, and whether it only comes near an earlier one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dropped_lines(docs).select("doc_id", F.col("at").cast("bigint").alias("line_no"), "near")
