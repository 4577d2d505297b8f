"""Language of the documents table."""

from __future__ import annotations

from siltstone.llm import language
from siltstone.llm.registry import query, table


@query()
def op2_language_id(spark, root):
    return language.identify(table(spark, root, "documents"))
