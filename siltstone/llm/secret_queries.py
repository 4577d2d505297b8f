"""Secrets in documents, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import secrets
from siltstone.llm.registry import query, table
from siltstone.session import work_dir


@query(r"""
WITH rules(rank, kind, least, pattern) AS (VALUES
  (0, 'assign', 12, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 18, '(AKIA[A-Z0-9]+)'),
  (2, 'hex', 16, '([0-9a-f]+)'),
  (3, 'pem', 0, '(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?)'),
  (4, 'jwt', 0, '(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})'),
  (5, 'forge', 0, '(gh[pousr]_[A-Za-z0-9]{36,})'),
  (6, 'login', 0, '([A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20/:@"''<>]+:[^\x00-\x20/:@"''<>]+@[A-Za-z0-9.-]+)')),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT row, rank, kind, least, regexp_extract_all(t, pattern) AS found, regexp_extract_all(t, pattern, 1) AS inner_part,
         list_transform(regexp_split_to_array(t, pattern), lambda x: length(x)) AS gaps
  FROM d, rules),
numbered AS (
  SELECT row, rank, kind, least, unnest(found) AS whole, unnest(inner_part) AS part, unnest(gaps[:len(found)]) AS gap, unnest(range(1, len(found) + 1)) AS k
  FROM cut WHERE len(found) > 0),
placed AS (
  SELECT *, CAST(sum(gap + length(whole)) OVER (PARTITION BY row, rank ORDER BY k) AS BIGINT) AS stop FROM numbered),
spans AS (
  SELECT row, rank, kind, stop - length(whole) AS start, stop FROM placed WHERE length(part) >= least),
joined AS (
  SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (row)
""")
def op11_secret_ledger(spark, root):
    ledger = secrets.Ledger(spark, work_dir(spark, "secret-ledger"))
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = ledger.load(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").cast("long").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.joined_text("spans", ["assign", "access", "hex"]), 256).alias("base_sha256"),
        secrets.joined_text("spans").alias("spans"),
    )
