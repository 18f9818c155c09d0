"""DuckDB SQL for the operators that SQL can express, over the same tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
    SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3]::DOUBLE AS weight,
           1.5 * (sum(source_size) OVER ())::DOUBLE AS total
    FROM sources
), fill AS (
    SELECT 0 AS round, source, source_size, weight, total, false AS capped FROM placed
    UNION ALL
    SELECT round + 1, source, source_size, weight, total, capped OR share > 2.0 * source_size
    FROM (SELECT *, weight * (total - coalesce(sum(CASE WHEN capped THEN 2.0 * source_size END) OVER (PARTITION BY round), 0))
                    / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (PARTITION BY round), 0) AS share FROM fill)
    WHERE round < 60
), targets AS (
    SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size ELSE weight * (total - coalesce(sum(CASE WHEN capped THEN 2.0 * source_size END) OVER (), 0))
           / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0) END AS target
    FROM fill WHERE round = 60
)
SELECT s.doc_id, s.size, t.source_size, round(t.target, 6) AS target FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""

OP7_MEASURES = rf"""
WITH w AS (
    SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents
), windows AS (
    SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice WHERE n > 1) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS whole FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
    SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(lines.whole, 0) AS BIGINT) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id
)"""

_RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 10 * n_words",
}

OP7 = OP7_MEASURES + f"""
, judged AS (
    SELECT *, {", ".join(f"({test}) AS {rule}" for rule, test in _RULES.items())} FROM measured
), failures AS (
    {" UNION ALL ".join(f"SELECT source, '{rule}' AS rule, CASE WHEN {rule} THEN 1 ELSE 0 END AS failed FROM judged" for rule in _RULES)}
), hosts AS (
    SELECT source, rule, count(*)::DOUBLE AS n, sum(failed)::DOUBLE AS f FROM failures GROUP BY source, rule
), sums AS (
    SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS hosts, sum(f * f / n) / sum(n) AS rr FROM hosts GROUP BY rule
), prior AS (
    SELECT rule, mean, CASE WHEN spread > 0 THEN least(10000.0, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 10000.0 END AS strength
    FROM (SELECT rule, mean, rr - mean * mean - mean * (1 - mean) * hosts / n AS spread FROM sums)
), rates AS (
    SELECT source, max((f + mean * strength) / (n + strength)) AS host_rate,
           bool_or((f + mean * strength) / (n + strength) > least(0.6, greatest(0.25, mean + 3 * sqrt(mean * (1 - mean) / (strength + 1))))) AS host_rejected
    FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeated_words AS base_failed,
       NOT ({" OR ".join(_RULES)}) AND NOT host_rejected AS kept,
       CAST({" + ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END" for rule in _RULES)} AS BIGINT) AS n_failed,
       host_rejected, round(host_rate, 9) AS host_rate
FROM judged j JOIN rates r ON j.source IS NOT DISTINCT FROM r.source
"""

#: Lines within one edit share one half of the shorter line, from the left or from the right.
OP5 = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
    SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)
), placed AS (
    SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), firsts AS (
    SELECT line, min(pos) AS first, length(line) AS n FROM placed GROUP BY line
), roles AS (
    SELECT *, n AS base, 0 AS role FROM firsts WHERE n >= 16 UNION ALL SELECT *, n - 1, 1 FROM firsts WHERE n >= 17
), keys AS (
    SELECT *, 'left' AS side, left(line, base // 2) AS part FROM roles UNION ALL SELECT *, 'right', right(line, base - base // 2) FROM roles
), pairs AS (
    SELECT DISTINCT a.line AS x, a.first AS fx, a.n AS n, b.line AS y, b.first AS fy, 1 - b.role AS same
    FROM keys a JOIN keys b ON a.base = b.base AND a.side = b.side AND a.part = b.part AND a.role = 0 AND a.line <> b.line
), near AS (
    SELECT x, fx, y, fy FROM pairs
    WHERE len(list_filter(range(0, n + 1), lambda i: left(x, i) = left(y, i) AND substr(x, i + 1 + same) = substr(y, i + 2))) > 0
), later AS (
    SELECT x AS line FROM near WHERE fy < fx UNION SELECT y FROM near WHERE fx < fy
)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, pos = first AS near
FROM placed JOIN firsts USING (line) WHERE pos > first OR line IN (SELECT line FROM later)
"""
