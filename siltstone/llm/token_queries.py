"""Queries that count, pack and store token ids of documents."""

from __future__ import annotations

import public_tokenizers

from siltstone.llm import packing, token_counts, token_files
from siltstone.llm.registry import query, table

LIMIT = 1024


@query()
def op7_token_counts(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", counted["n_tokens"] > LIMIT)


@query()
def op9_token_files(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    return token_files.round_trip(spark, docs, public_tokenizers.path("word_bpe_49k.json"), 2)


@query()
def op3_packing(spark, root):
    docs = table(spark, root, "documents")
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)
