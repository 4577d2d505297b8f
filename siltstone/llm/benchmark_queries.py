"""Benchmark passages in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import decontaminate
from siltstone.llm.registry import query, table


@query(r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))),
found AS (SELECT row, i, size, item_id FROM dw JOIN bw USING (size, win)),
hit AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
items AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS all
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.all, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
""")
def op8_decontamination(spark, root):
    found = decontaminate.find(spark, table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
