"""All queries of this subpackage; importing the modules registers them."""

from siltstone.llm import benchmark_queries, chat_queries, infilling_queries, language_queries, near_queries, page_queries, secret_queries, text_queries, token_queries, vector_queries  # noqa: F401
from siltstone.llm.registry import ORACLES, QUERIES  # noqa: F401
