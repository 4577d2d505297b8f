"""Joins by time: the newest earlier row, and intervals that overlap.

Neither puts all rows of a key into one task. The as-of join deals each key into slices of time and carries the newest
row of earlier slices into each; the interval join deals intervals to cells of a width of their own size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _moment(c: Column, df: DataFrame, name: str) -> Column:
    """Microseconds of a time, or the number itself."""
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(c) * 86_400_000_000
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), "UTC"))
    return F.unix_micros(c) if kind == "timestamp" else c.cast("long")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], width: int,
    tie: str | None = None, prefix: str = "",
) -> DataFrame:
    """All rows of ``left`` with ``values`` of the newest row of ``right`` that has the same keys and is not later.

    Rows without an earlier one get NULLs, as do those without a time; right rows without a time count for nothing. NULL
    keys match nothing. Of right rows with the same time the one with the largest ``tie`` counts, then the largest values.
    ``width`` is the length of a slice in the unit of the times (microseconds of timestamps).

    Per key and slice the newest right row is its head; heads, one a slice, are carried to the next slices that
    hold anything, and enter them as their first row. So a window covers a slice of a key, and the one over a whole key
    only its heads.
    """
    own = left.columns
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    rank = [F.col(tie)] if tie else []
    held = F.struct(_moment(F.col(right_time), right, right_time).alias("t"), *[c.alias(f"o{i}") for i, c in enumerate(rank)], *[F.col(v) for v in values])
    ks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    rights = right.filter(some & F.col(right_time).isNotNull()).select(*ks, held.alias("_held"))
    rights = rights.withColumn("_t", F.col("_held.t")).withColumn("_slice", F.floor(F.col("_t") / F.lit(width)))
    whole = F.struct(*[F.col(f"`{c}`") for c in own])
    moment = F.when(some, _moment(F.col(left_time), left, left_time))
    lefts = left.select(*ks, whole.alias("_row"), moment.alias("_t")).withColumn("_slice", F.floor(F.col("_t") / F.lit(width)))
    timed = lefts.filter(F.col("_t").isNotNull())

    heads = rights.groupBy(*names, "_slice").agg(F.max("_held").alias("_head"))
    there = timed.groupBy(*names, "_slice").agg(F.lit(1).alias("_one")).drop("_one")
    every = heads.unionByName(there.withColumn("_head", F.lit(None).cast(heads.schema["_head"].dataType)))
    every = every.groupBy(*names, "_slice").agg(F.max("_head").alias("_head"))
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_held", F.last("_head", ignorenulls=True).over(before)).filter("_held IS NOT NULL")
    entering = carried.select(*names, "_slice", F.lit(None).cast("long").alias("_t"), F.lit(0).alias("_side"), "_held")

    none = F.lit(None).cast(heads.schema["_head"].dataType)
    gone = F.lit(None).cast(lefts.schema["_row"].dataType)
    events = (
        entering.withColumn("_row", gone)
        .unionByName(rights.select(*names, "_slice", "_t", F.lit(1).alias("_side"), "_held").withColumn("_row", gone))
        .unionByName(timed.select(*names, "_slice", "_t", F.lit(2).alias("_side"), none.alias("_held"), "_row"))
    )
    within = Window.partitionBy(*names, "_slice").orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_held").asc_nulls_first())
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = events.withColumn("_found", F.last("_held", ignorenulls=True).over(upto)).filter("_side = 2")
    rest = lefts.filter(F.col("_t").isNull()).select("_row", none.alias("_found"))
    out = placed.select("_row", "_found").unionByName(rest)
    return out.select("_row.*", *[F.col("_found")[v].alias(prefix + v) for v in values])


#: Levels of cells: level n has cells of 2 ** n units.
LEVELS = 62


def _spans(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    a, b = _moment(F.col(start), df, start), _moment(F.col(end), df, end)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"_{side}"), a.alias(f"_a{side}"), b.alias(f"_b{side}"))
    rows = rows.filter(F.col(f"_a{side}") <= F.col(f"_b{side}"))
    length = F.col(f"_b{side}") - F.col(f"_a{side}")
    # The smallest cell that is no shorter than the interval, so that it lies in two cells at most.
    return rows.withColumn(f"_l{side}", F.when(length <= 1, F.lit(0)).otherwise(F.length(F.bin(length - 1))).cast("int"))


def _cells(rows: DataFrame, side: str, levels: Column) -> DataFrame:
    """Each interval once for every cell of the given levels that it touches."""
    dealt = rows.withColumn("_level", F.explode(levels))
    first, last = (F.expr(f"shiftright(_{e}{side}, _level)") for e in "ab")
    return dealt.withColumn(f"_c{side}", first).withColumn("_cell", F.explode(F.sequence(first, last)))


def overlapping(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """All pairs (``l``, ``r``) of rows as structs with the same keys whose closed intervals have a moment in common.

    Intervals without a start or an end, or that end before they start, overlap nothing, and NULL keys match nothing.

    An interval lies in at most two cells of its own level (cells no shorter than itself). Two intervals meet on the
    level of the longer one, where the shorter lies in two cells at most as well, so a long interval is not cut into many
    pieces and a short one does not meet all of its key. A pair is reported by the first cell that both touch.
    """
    a, b = _spans(left, *left_span, "l"), _spans(right, *right_span, "r")

    def levels_of(rows: DataFrame, side: str) -> list[int]:
        # At most one number per level.
        return sorted(r[0] for r in rows.select(f"_l{side}").distinct().collect())

    at_left, at_right = levels_of(a, "l"), levels_of(b, "r")
    number = lambda found: F.array(*[F.lit(x) for x in found]).cast("array<int>")
    longer_left = _met(
        _cells(a, "l", F.array("_ll")), _cells(b, "r", F.filter(number(at_left), lambda x: x >= F.col("_lr"))), keys
    )
    longer_right = _met(
        _cells(a, "l", F.filter(number(at_right), lambda x: x > F.col("_ll"))), _cells(b, "r", F.array("_lr")), keys
    )
    return longer_left.unionByName(longer_right)


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    a = a.withColumnsRenamed({"_level": "_level_l", "_cell": "_cell_l"})
    on = (F.col("_level_l") == F.col("_level")) & (F.col("_cell_l") == F.col("_cell"))
    for k in keys:
        on = on & (F.col(f"_l.{k}") == F.col(f"_r.{k}"))
    overlap = (F.col("_al") <= F.col("_br")) & (F.col("_ar") <= F.col("_bl"))
    met = a.join(b, on).filter(overlap & (F.col("_cell") == F.greatest("_cl", "_cr")))
    return met.select(F.col("_l").alias("l"), F.col("_r").alias("r"))
