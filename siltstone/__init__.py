"""Siltstone: ingest, discover and query a lake of tables with plain Spark DataFrames."""
