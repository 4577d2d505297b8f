"""Near duplicates of the documents table."""

from __future__ import annotations

from siltstone.llm import near_duplicates as near
from siltstone.llm.registry import query, table


@query()
def op5_near_duplicates(spark, root):
    return near.near_duplicates(spark, table(spark, root, "documents"))
