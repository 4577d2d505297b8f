"""Result shapes of dashboard widgets.

Every shape first aggregates to the grain it shows; window functions then run over those few rows
(an axis of calendar periods, a list of stages, the top k) and not over the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.values import safe_ratio
from siltstone.session import small_frame


def period_change(
    df: DataFrame, period: str, value: Column, ts: str, dims: list[str] | None = None, guarded: bool = True
) -> DataFrame:
    """Value per period, the previous period's value and the change in percent.

    Guarded, the change is 0 where the previous value is not positive; otherwise it is the plain
    ratio (NULL for a previous value of 0). The first period has no change.
    """
    dims = dims or []
    per = df.groupBy(*dims, F.date_trunc(period, ts).alias("period")).agg(value.cast("double").alias("value"))
    over = Window.partitionBy(*dims).orderBy("period")
    prev = F.col("previous")
    ratio = (F.col("value") - prev) / F.nullif(prev, F.lit(0.0)) * 100
    change = F.when(prev.isNull(), None).when(prev > 0, ratio)
    change = change.otherwise(0.0) if guarded else change.otherwise(ratio)
    return per.withColumn("previous", F.lag("value").over(over)).withColumn("change_pct", change)


def comparison(current: Column, previous: Column) -> Column:
    """Change in percent of two values side by side; 0 when there is nothing positive to compare to."""
    return F.when(previous > 0, (current - previous) / previous * 100).otherwise(F.lit(0.0))


def funnel(df: DataFrame, stage: str, entity: str, stages: list[str]) -> DataFrame:
    """Distinct entities per stage, width relative to the first and conversion from the one before.

    Stages follow the given list; a stage nobody reached counts 0. Conversion is rounded to one
    decimal and NULL for the first stage.
    """
    reached = (
        df.filter(F.col(stage).isin(stages))
        .select(F.col(stage).alias("_stage"), F.col(entity).alias("_e"))
        .groupBy("_stage")
        .agg(F.count_distinct("_e").alias("n"))
    )
    order = small_frame(df.sparkSession, list(enumerate(stages, 1)), "step int, stage string")
    counted = order.join(reached, F.col("stage") == F.col("_stage"), "left").select(
        "step", "stage", F.coalesce("n", F.lit(0)).alias("value")
    )
    return _with_conversion(counted)


def funnel_of_counts(counts: DataFrame) -> DataFrame:
    """The same for stages already counted: columns step, stage, value."""
    return _with_conversion(counts)


def _with_conversion(counted: DataFrame) -> DataFrame:
    # One row per stage of a given list.
    over = Window.orderBy("step")
    first = F.first("value").over(over)
    prev = F.lag("value").over(over)
    return counted.select(
        "step",
        "stage",
        "value",
        (F.col("value") / F.nullif(first, F.lit(0)) * 100).alias("width"),
        F.round(F.col("value") / F.nullif(prev, F.lit(0)) * 100, 1).alias("conversion"),
    )


def leaderboard(
    df: DataFrame, entity: str, value: Column, ts: str, period: str, k: int = 50
) -> DataFrame:
    """The k entities with the highest value, ranked, with the trend of their last two periods.

    The top k are cut before ranking, and trends are computed for those entities only.
    """
    top = (
        df.groupBy(entity)
        .agg(value.cast("double").alias("value"))
        .orderBy(F.desc("value"), entity)
        .limit(k)
    )
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), entity)))
    latest = df.agg(F.date_trunc(period, F.max(ts))).scalar()
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH",
            "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}[period]
    start = F.date_trunc(period, ts)
    members = ranked.select(F.col(entity).alias("_member"))
    recent = (
        df.join(members, F.col(entity) == F.col("_member"), "left_semi")
        .filter(F.col(ts) >= latest - F.expr(step))
        .groupBy(F.col(entity).alias("_entity"), start.alias("_period"))
        .agg(value.cast("double").alias("_v"))
        .withColumn("_newest", F.col("_period") == latest)
        .groupBy("_entity")
        .agg(
            F.max(F.when(F.col("_newest"), F.col("_v"))).alias("_cur"),
            F.max(F.when(~F.col("_newest"), F.col("_v"))).alias("_prev"),
        )
    )
    trend = comparison(F.coalesce("_cur", F.lit(0.0)), F.coalesce("_prev", F.lit(0.0)))
    return ranked.join(recent, F.col(entity) == F.col("_entity"), "left").select(
        "rank", F.col(entity).alias("label"), "value", F.round(trend, 1).alias("trend")
    )


def share(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Value per name and its share of the total in percent."""
    parts = df.groupBy(name).agg(value.alias("value"))
    total = parts.agg(F.sum("value")).scalar().cast("double")
    v = F.col("value").cast("double")
    return parts.select(F.col(name).alias("name"), v.alias("value"), (safe_ratio(v, total) * 100).alias("share"))


def progress(value: Column, target: Column) -> Column:
    """Percent of a target reached, at most 100."""
    return F.least(value / target * 100, F.lit(100.0))


def _listed(value: Column, known: list) -> Column:
    """The value, or an error where it has no column to go to (NULL has none either)."""
    missing = F.raise_error(F.concat(F.lit("no column is given for "), F.coalesce(value.cast("string"), F.lit("NULL"))))
    return F.when(value.isin(known), value).otherwise(missing)


def heatmap(
    df: DataFrame, ts: str, value: Column, hours: list[int] | None = None, scale: float = 100.0
) -> DataFrame:
    """Weekday by hour matrix, one column per hour, missing cells 0.

    Weekday is 1 for Monday; the hours are a fixed list, so the pivot needs no extra job.
    """
    hours = list(range(24)) if hours is None else hours
    cells = (
        df.select((F.weekday(ts) + 1).alias("weekday"), _listed(F.hour(ts), hours).alias("_hour"), "*")
        .groupBy("weekday")
        .pivot("_hour", hours)
        .agg((value / scale).cast("double"))
    )
    return cells.select("weekday", *[F.coalesce(F.col(f"`{h}`"), F.lit(0.0)).alias(f"h{h:02d}") for h in hours])


def series(df: DataFrame, index: Column, index_name: str, category: str, categories: list[str], value: Column) -> DataFrame:
    """Index column plus one value column per given category; a category that is not given raises."""
    known = df.withColumn(category, _listed(F.col(category), categories))
    return known.groupBy(index.alias(index_name)).pivot(category, categories).agg(value.cast("double"))


def treemap(df: DataFrame, levels: list[str], value: Column) -> DataFrame:
    """Totals of every node of a hierarchy; ``depth`` is 0 for the whole.

    A rolled-up level is NULL, and so is a real NULL in the data: ``depth`` tells them apart.
    """
    rolled = df.rollup(*levels).agg(value.cast("double").alias("value"), F.grouping_id().alias("_gid"))
    depth = reduce(
        lambda acc, i: F.when(F.col("_gid") == (1 << i) - 1, len(levels) - i).otherwise(acc),
        range(len(levels) + 1),
        F.lit(None).cast("int"),
    )
    return rolled.select(*levels, depth.alias("depth"), "value")


def waterfall(df: DataFrame, ts: str, period: str, value: Column, dims: list[str] | None = None) -> DataFrame:
    """Change per calendar period with the running level before and after it."""
    dims = dims or []
    steps = df.groupBy(*dims, F.date_trunc(period, ts).alias("step")).agg(value.alias("_delta"))
    over = Window.partitionBy(*dims).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_delta").over(over)
    return steps.select(
        *dims,
        "step",
        F.col("_delta").cast("double").alias("delta"),
        (end - F.col("_delta")).cast("double").alias("start"),
        end.cast("double").alias("end"),
    )


def flows(df: DataFrame, entity: str, ts: str, tiebreak: str, node: str) -> DataFrame:
    """How often one node is directly followed by another within an entity's sequence."""
    from siltstone.functions.sequences import with_next

    steps = with_next(df.select(entity, ts, tiebreak, node), entity, ts, tiebreak, node, "_target")
    return (
        steps.filter(F.col("_target").isNotNull())
        .groupBy(F.col(node).alias("source"), F.col("_target").alias("target"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def sparkline(df: DataFrame, entity: str, ts: str, period: str, value: Column) -> DataFrame:
    """Per entity the ordered list of period values; its length is bounded by the calendar."""
    points = df.groupBy(entity, F.date_trunc(period, ts).alias("_t")).agg(value.cast("double").alias("_v"))
    return points.groupBy(entity).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda p: p["_v"]).alias("points")
    )


def radar(df: DataFrame, entity: str, measures: dict[str, Column]) -> DataFrame:
    """Measures per entity scaled to 0 to 100 between the lowest and highest entity."""
    raw = df.groupBy(entity).agg(*[c.cast("double").alias(n) for n, c in measures.items()])
    bounds = raw.agg(
        F.struct(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in measures]).alias("b")
    ).scalar()
    scaled = raw.withColumn("_b", bounds)
    return scaled.select(
        entity,
        *[
            (safe_ratio(F.col(n) - F.col("_b")[n]["lo"], F.col("_b")[n]["hi"] - F.col("_b")[n]["lo"]) * 100).alias(n)
            for n in measures
        ],
    )


def scatter(df: DataFrame, entity: str, x: Column, y: Column, size: Column | None = None) -> DataFrame:
    """Two measures per entity, or three for bubbles."""
    measures = [x.cast("double").alias("x"), y.cast("double").alias("y")]
    if size is not None:
        measures.append(size.cast("double").alias("size"))
    return df.groupBy(entity).agg(*measures)


def feed(df: DataFrame, ts: str, tiebreak: str, k: int = 20) -> DataFrame:
    """The k newest rows, newest first."""
    return df.orderBy(F.desc(ts), F.desc(tiebreak)).limit(k)
