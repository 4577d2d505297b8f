"""Connected components of links, by alternating stars on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def components(spark: SparkSession, links: DataFrame, folder: str) -> DataFrame:
    """Of links (a, b): every linked node with the smallest node that it reaches, as (node, label).

    Each round hangs the larger neighbours of every node, then the smaller ones, onto the smallest neighbour;
    the rounds end when the links stay the same, and they grow with the logarithm of the longest chain. Every
    round is a written table, so neither plan nor lost work grows with the rounds.
    """
    edges, now = _kept(spark, _oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), f"{folder}/0")
    before, k = None, 0
    while now != before and now[0]:
        before, k = now, k + 1
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        wide = both.join(low, F.col("u") == F.col("w")).where("v > u")
        large = wide.select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")).where("u != v")
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        down = large.join(low, F.col("u") == F.col("w"))
        small = _oriented(down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*"))
        edges, now = _kept(spark, small, f"{folder}/{k}")
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return hung.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _kept(spark: SparkSession, edges: DataFrame, at: str) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and the sum of their hashes, which are equal if the edges are."""
    seen = Observation()
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("h")).write.parquet(at)
    return spark.read.parquet(at), (seen.get["n"], seen.get["h"])
