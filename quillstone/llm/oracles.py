"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Base counts of each text, and the verdict of the rules (the order of the cascade doesn't change it).
_CASCADE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d
), windows AS (
  SELECT r, i, ws[i:i+4] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n >= 2
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), base AS (
  SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND word_chars BETWEEN 2 * n_words AND 30 * n_words
       AND 10 * n_symbols <= 3 * n_words
       AND 10 * n_dup_lines <= 3 * n_lines
       AND 2 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) <= word_chars
       AND 2 * length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) >= word_chars
       AND 5 * length(regexp_replace(t, '[^!]+', '', 'g')) <= 2 * n_words AS kept
FROM base
"""

ORACLES = {"op4_quality_cascade": _CASCADE}

#: Exact divergences in 128-bit integers; every kept term of a lang beside every group of it, absent ones included.
_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counted USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
         1 + (1000000000 * (k.lang_n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES["op12_source_divergence"] = _DIVERGENCE
