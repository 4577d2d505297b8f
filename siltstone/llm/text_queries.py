"""Queries over document texts, with the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.llm import line_rules
from siltstone.llm.registry import query, table


@query(r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
base AS (
  SELECT doc_id, source, text, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM base)),
twins AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, CAST(sum(least(8, i - before)) AS BIGINT) AS n
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS before FROM twins) GROUP BY 1),
lines AS (
  SELECT DISTINCT doc_id, source, line FROM (
    SELECT doc_id, source,
           unnest(list_transform(string_split(lower(text), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g')))) AS line
    FROM d) WHERE line <> ''),
often AS (SELECT source, line, min(doc_id) AS first FROM lines GROUP BY source, line HAVING count(DISTINCT doc_id) > 10),
gone AS (
  SELECT l.doc_id, CAST(sum(len(string_split(a.line, ' '))) AS BIGINT) AS n FROM (
    SELECT doc_id, source,
           unnest(list_transform(string_split(lower(text), chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g')))) AS line
    FROM d) a JOIN often o ON a.source IS NOT DISTINCT FROM o.source AND a.line = o.line AND a.doc_id <> o.first
  JOIN d l ON l.doc_id = a.doc_id GROUP BY 1),
judged AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS n_removed_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id LEFT JOIN gone g ON b.doc_id = g.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM judged
""")
def op4_line_rules(spark, root):
    judged = line_rules.apply_rules(table(spark, root, "documents").select("doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"
    )
