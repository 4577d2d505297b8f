"""Exact medians that no single task has to hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sketch accuracy, the bracket around the middle (ten times the sketch's rank error) and the
# number of equal parts it is divided into.
_ACCURACY = 10_000
_MARGIN = 10 / _ACCURACY
_PARTS = 1000


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Exact median of ``value`` per key, with linear interpolation for even counts.

    The built-in exact median keeps every value of a group in one aggregation buffer. Here a
    sketch first gives each group a bracket that is sure to hold the middle; rows below it are
    only counted. The distinct values inside (about 0.2 % of the group) are counted in a thousand
    parts of the bracket, and only the part or two that hold the middle are ordered. Every
    aggregation combines before it shuffles, so a hot group stays spread out.
    """
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], value.cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull())
    ks = [f"_k{i}" for i in range(len(keys))]

    sketch = F.percentile_approx("_v", [0.5 - _MARGIN, 0.5 + _MARGIN], _ACCURACY)
    brackets = rows.groupBy(*ks).agg(sketch.alias("_b"), F.count(F.lit(1)).alias("_n"))

    if ks:
        right = brackets.select(*[F.col(k).alias(f"_r{k}") for k in ks], "_b", "_n")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in ks])
        marked = rows.join(right, on).drop(*[f"_r{k}" for k in ks])
    else:
        one = brackets.select(F.struct("_b", "_n").alias("s")).scalar()
        marked = rows.withColumn("_s", one).select("_v", F.col("_s._b").alias("_b"), F.col("_s._n").alias("_n"))

    # Rows below the bracket collapse to one entry (NULL value, part -1), rows above vanish.
    low, high = F.col("_b")[0], F.col("_b")[1]
    near = marked.filter(F.col("_v") <= high).select(
        *ks, F.when(F.col("_v") >= low, F.col("_v")).alias("_v"), low.alias("_lo"), high.alias("_hi"), "_n"
    )
    counted = near.groupBy(*ks, "_v").agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("_lo", "_hi", "_n")]
    )
    part = F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * _PARTS)
    counted = counted.withColumn("_p", F.when(F.col("_v").isNull(), -1).otherwise(F.coalesce(part, F.lit(0))))

    ranks = [F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)]
    parts = counted.groupBy(*ks, "_p").agg(F.sum("_c").alias("_pc"), F.first("_n").alias("_n"))
    parts = parts.withColumn("_upto", F.sum("_pc").over(Window.partitionBy(*ks).orderBy("_p")))
    before = F.col("_upto") - F.col("_pc")
    chosen = parts.filter((before < ranks[1]) & (ranks[0] <= F.col("_upto"))).select(
        *[F.col(k).alias(f"_q{k}") for k in ks], F.col("_p").alias("_qp"), before.alias("_offset")
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_q{k}")) for k in ks], F.col("_p") == F.col("_qp"))
    inside = counted.join(chosen, on)
    within = Window.partitionBy(*ks, "_p").orderBy("_v")
    placed = inside.withColumn("_upto", F.sum("_c").over(within) + F.col("_offset"))

    def at(rank: Column) -> Column:
        hit = (F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto"))
        return F.max(F.when(hit, F.col("_v")))

    middle = placed.groupBy(*ks).agg(((at(ranks[0]) + at(ranks[1])) / 2).alias(name))
    return middle.select(*[F.col(k).alias(keys[i]) for i, k in enumerate(ks)], name)
