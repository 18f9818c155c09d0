"""From documents to token ids: five stages, each one operator of ``sluice.llm`` over all rows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. quality: documents that fail a rule, or whose host is rejected, go.
2. line_dedup: lines that an earlier document or line has, within one edit, go; a document that loses
   every line goes.
3. near_dedup: fingerprints of five-word shingles are compared in tiles, and one document of each
   group stays whose shingles have a Jaccard similarity of 0.8 or more.
4. mixing: words are taken from each source by its target weight, in blocks; a document comes once,
   twice or in part.
5. encode: byte-level BPE ids of each text, with digests of the ids and of what they decode to.

The stages are those of the operators' own rules, so what they say of nulls, ties, repeated rows and
empty tables holds here. SQL cannot express the hashes of stages 3 to 5; the tests hold run() against
a brute-force version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import bpe, line_dedup, mixing, near_sets, quality
from sluice.llm.common import dropped, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_sets.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.encode_documents(docs, ["doc_id", "source"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("line_dedup", drop_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("encode", encode),
]

#: SQL has neither XXH64 nor the tokenizer's merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
