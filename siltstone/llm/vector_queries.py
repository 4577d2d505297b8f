"""Whitened embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import whitening
from siltstone.llm.registry import query, table


@query()
def op13_embedding_whitening(spark, root):
    found = whitening.whiten(spark, table(spark, root, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
