"""Queries over web pages."""

from __future__ import annotations

from siltstone.llm import html_text, warc
from siltstone.llm.registry import query, table


@query(r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS digest FROM pages),
s AS (SELECT *, strlen(t) AS n FROM p),
l AS (SELECT digest, max(page_id) AS leader FROM s WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s.digest AS payload_digest,
       CASE WHEN page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < leader THEN leader END AS refers_to
FROM s LEFT JOIN l ON s.digest = l.digest AND n >= 1000
""")
def op1_warc(spark, root):
    back = warc.round_trip(spark, table(spark, root, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op10_html_text(spark, root):
    return html_text.extract(table(spark, root, "pages"))
