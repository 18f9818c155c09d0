"""Quality rules with verdicts on hosts, with DataFrame functions only.

Each document is measured and held against five rules (few words, repeated words, symbols, repeated
lines, mean word length). Failures are added up by host (``source``; of a page, its domain) for each
rule, and the hosts' rates are shrunk towards the corpus by a beta prior of that rule, whose two
parameters are fitted to all hosts by moments. A host is rejected if its shrunk rate of any rule is
above the rule's limit, ``LIMIT_SPREADS`` standard deviations of the prior above its mean, though not
below ``LEAST_LIMIT`` nor above ``MOST_LIMIT``. Hosts that differ by chance only are thus never
rejected. A document is kept if it passes all rules and its host is not rejected.

Defined results: null text has no words and fails, as an empty one does; very long texts are measured
whole; a null host is a group of its own; an empty table gives no rows. Repeated rows count as often
as they stand there. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_RE, WORD_RE, let, present, small, words, written

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "[#*$%&|<>]"
#: Symbols and twice-held lines in a hundred words or lines, mean characters of a word.
SYMBOL_PERCENT, DUP_LINE_PERCENT, LEAST_MEAN, MOST_MEAN = 10, 30, 2, 10
#: A host's limit in the prior's standard deviations, and what it is at least and at most.
LIMIT_SPREADS, LEAST_LIMIT, MOST_LIMIT = 3.0, 0.25, 0.6
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")


def repeated_words(hashes: Column, width: int = REPEAT_WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the text holds twice or more."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, width)))

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        return F.aggregate(F.transform(starts, lambda p, k: F.when(k < last, F.least(F.lit(width), F.get(starts, k + 1) - p)).otherwise(F.lit(width))), F.lit(0), lambda a, b: a + b)

    def placed(at: Column) -> Column:  # (hash, place) in order: equal windows are neighbours
        last = F.size(at) - 1
        twin = F.filter(at, lambda x, k: ((k > 0) & (F.get(at, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k < last) & (F.get(at, k + 1)["h"] == x["h"])))
        return let(F.sort_array(F.transform(twin, lambda x: x["p"])), covered)

    def counted(ws: Column) -> Column:
        def judged(s: Column) -> Column:
            twice = F.exists(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i > 0) & (F.get(s, i) == F.get(s, F.greatest(i - 1, F.lit(0)))))
            return F.when(twice, let(F.sort_array(F.transform(ws, lambda h, p: F.struct(h.alias("h"), p.alias("p")))), placed)).otherwise(F.lit(0))

        return let(F.sort_array(ws), judged)

    return F.when(n < width + 1, F.lit(0)).otherwise(let(windows, counted)).cast("bigint")


def measures(text: Column) -> dict[str, Column]:
    """The base measures by name; each is a long."""
    text = present(text)
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_RE))
    return {
        "n_words": F.size(words(text)).cast("bigint"),
        "word_chars": F.char_length(F.regexp_replace(text, GAP_RE, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": let(hashes, repeated_words),
    }


def rules() -> dict[str, Column]:
    """Whether a measured document fails each rule; one without words fails the first."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < LEAST_MEAN * n) | (F.col("word_chars") > MOST_MEAN * n),
    }


def host_rates(rows: DataFrame, host: str) -> DataFrame:
    """(host, n_docs, rejected, and the shrunk rate of each rule); the priors come from all hosts.

    Moments: with weights n_docs, mean m and variance v of the rates, less the binomial part
    m(1-m)/n of v, give the strength m(1-m)/v - 1, held between 1 and 10 000 so that equal or
    single hosts still give a proper prior.
    """
    by_host = rows.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("bigint")).alias(f"_f_{r}") for r in RULES])
    sums = by_host.agg(
        F.sum("n_docs").alias("_n"), F.count(F.lit(1)).alias("_hosts"),
        *[F.sum(f"_f_{r}").alias(f"_s_{r}") for r in RULES],
        *[F.sum(F.col(f"_f_{r}") * F.col(f"_f_{r}") / F.col("n_docs")).alias(f"_rr_{r}") for r in RULES],
    ).filter("_n > 0")

    def prior(rule: str) -> list[Column]:
        mean = F.col(f"_s_{rule}") / F.col("_n")
        spread = F.col(f"_rr_{rule}") / F.col("_n") - mean * mean - mean * (1 - mean) * F.col("_hosts") / F.col("_n")
        strength = F.when(spread > 0, F.least(F.lit(1e4), F.greatest(F.lit(1.0), mean * (1 - mean) / spread - 1))).otherwise(F.lit(1e4))
        limit = mean + LIMIT_SPREADS * F.sqrt(mean * (1 - mean) / (strength + 1))
        return [mean.alias(f"_mean_{rule}"), strength.alias(f"_strength_{rule}"), F.least(F.lit(MOST_LIMIT), F.greatest(F.lit(LEAST_LIMIT), limit)).alias(f"_limit_{rule}")]

    # One row of sums: its size does not depend on the data.
    priors = F.broadcast(sums.select(*[c for r in RULES for c in prior(r)]))
    shrunk = {r: (F.col(f"_f_{r}") + F.col(f"_mean_{r}") * F.col(f"_strength_{r}")) / (F.col("n_docs") + F.col(f"_strength_{r}")) for r in RULES}
    over = F.array(*[shrunk[r] > F.col(f"_limit_{r}") for r in RULES])
    return by_host.crossJoin(priors).select(host, "n_docs", F.exists(over, lambda x: x).alias("rejected"), *[c.alias(r) for r, c in shrunk.items()])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, measures, base_failed, n_failed (rules), host_rate, host_rejected and kept; one row a document."""
    rows = docs.select("doc_id", "source", *[c.alias(k) for k, c in measures(F.col("text")).items()])
    rows = rows.select("*", *[c.alias(r) for r, c in rules().items()])
    # Written because it is read twice, for the hosts and for the verdicts; it holds no text.
    judged = with_verdicts(written(rows, "measures"))
    return judged.withColumn("base_failed", F.col("few_words") | F.col("repeated_words")).drop(*RULES)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), "source", *[c.alias(k) for k, c in measures(F.col("text")).items()])
    rows = rows.select("row", "source", *[c.alias(r) for r, c in rules().items()])
    failed = F.array(*RULES)
    # Measured once: what the rules leave is written beside the failures that hosts are judged by.
    rows = rows.select(F.when(~F.exists(failed, lambda x: x), F.col("row")).alias("row"), "source", *RULES)
    return with_verdicts(written(rows, "judged")).filter("kept").select("row.*")


def with_verdicts(rows: DataFrame) -> DataFrame:
    """``rows``, which hold source and the rules' failures, with n_failed, host_rate (the greatest of its rules), host_rejected and kept."""
    hosts = host_rates(rows, "source").select(F.col("source").alias("_host"), F.greatest(*RULES).alias("host_rate"), F.col("rejected").alias("host_rejected"))
    # A window over the host would bring a hot host to one task. The verdicts are joined instead, without
    # moving the documents if the hosts, counted, are few enough.
    hosts = small(written(hosts, "hosts"), 128)
    joined = rows.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    failures = F.size(F.filter(F.array(*RULES), lambda x: x))
    return joined.withColumn("n_failed", failures).withColumn("kept", (failures == 0) & ~F.col("host_rejected"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    rows = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_failed").cast("bigint").alias("n_failed"), "host_rejected", F.round("host_rate", 9).alias("host_rate"))
