"""Metric queries: aggregations by breakdown over a time range, optionally across related tables."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.quantiles import exact_median

# Rolling ranges in days and the display labels they go by.
RANGE_DAYS = {"7d": 7, "14d": 14, "30d": 30, "90d": 90, "365d": 365}
RANGE_LABELS = {
    "Last 7 Days": "7d",
    "Last 14 Days": "14d",
    "Last 30 Days": "30d",
    "Last 90 Days": "90d",
    "Last 365 Days": "365d",
    "Month To Date": "mtd",
    "Year To Date": "ytd",
    "Custom Range": "custom",
    "All time": "all",
}


@dataclass(frozen=True)
class Metric:
    """A named aggregation of a column or SQL expression (``*`` counts rows)."""

    name: str
    aggregation: str
    column: str = "*"


@dataclass(frozen=True)
class TimeRange:
    """A range of a time column; the anchor is a timestamp text, or the newest row if left out."""

    column: str
    range: str = "all"
    anchor: str | None = None
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class Visualization:
    kind: str
    metrics: list[str]
    breakdown: str | None = None
    title: str | None = None
    limit: int | None = None


@dataclass(frozen=True)
class DashboardPlan:
    title: str
    metrics: list[Metric]
    visualizations: list[Visualization]
    time: TimeRange | None = None
    filters: list[str] = field(default_factory=list)


def date_range(df: DataFrame, time: TimeRange) -> DataFrame:
    """Rows of ``df`` inside a time range.

    A rolling range is relative to the anchor, never to the clock, so results repeat. Without an
    anchor it is the newest value, read by a scalar subquery over that one column.
    """
    kind = RANGE_LABELS.get(time.range, time.range)
    ts = F.col(time.column)
    if kind == "all":
        return df
    if kind == "custom":
        bounds = [ts >= _moment(df, time, time.start)] if time.start else []
        bounds += [ts <= _moment(df, time, time.end)] if time.end else []
        if not bounds:
            raise ValueError("a custom range needs a start or an end")
        return df.filter(reduce(lambda a, b: a & b, bounds))
    if kind in RANGE_DAYS:
        first = lambda anchor: anchor - F.make_dt_interval(days=F.lit(RANGE_DAYS[kind]))
    elif kind in ("mtd", "ytd"):
        first = lambda anchor: F.date_trunc("month" if kind == "mtd" else "year", anchor)
    else:
        raise ValueError(f"unknown time range: {time.range}")
    if time.anchor:
        anchor = _moment(df, time, time.anchor)
        return df.filter((ts >= first(anchor)) & (ts <= anchor))
    # The whole bound is the subquery's, so that the scan gets a plain comparison; the newest row needs no upper one.
    return df.filter(ts >= df.agg(first(F.max(time.column)).cast(df.schema[time.column].dataType)).scalar())


def _moment(df: DataFrame, time: TimeRange, text: str) -> Column:
    return F.lit(text).cast(df.schema[time.column].dataType)


def query(
    df: DataFrame,
    metrics: list[Metric],
    breakdown: list[str] | str | None = None,
    filters: list[str] | None = None,
    time: TimeRange | None = None,
    descending: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """One row per breakdown value (one row in all without a breakdown), index column first.

    Everything but medians is a single partial + final aggregation. With a ``limit`` the rows are
    the top ones by the first metric; ties are ordered by the breakdown.
    """
    keys = [breakdown] if isinstance(breakdown, str) else list(breakdown or [])
    rows = df if time is None else date_range(df, time)
    for condition in filters or []:
        rows = rows.filter(condition)

    plain = [m for m in metrics if m.aggregation == "none"]
    if plain:
        if len(plain) < len(metrics):
            raise ValueError("a metric without aggregation cannot stand beside aggregated ones")
        return rows.select(*keys, *[F.expr(m.column).alias(m.name) for m in plain]).limit(limit) if limit else rows.select(
            *keys, *[F.expr(m.column).alias(m.name) for m in plain]
        )

    # All rows decide which groups there are; a median may have nothing to say about some.
    aggregated = [m for m in metrics if m.aggregation != "median"]
    result = rows.groupBy(*keys).agg(*[_aggregate(m).alias(m.name) for m in aggregated] or [F.count(F.lit(1)).alias("_rows")])
    shares = [m for m in aggregated if m.aggregation == "percentage"]
    if shares:
        totals = {m.name: result.agg(F.sum(m.name)).scalar() for m in shares}
        result = result.withColumns(
            {name: F.col(name).cast("double") / total.cast("double") * 100 for name, total in totals.items()}
        )
    for m in metrics:
        if m.aggregation == "median":
            middle = exact_median(rows, keys, F.expr(m.column), m.name)
            result = _beside(result, middle, keys)
    result = result.select(*keys, *[m.name for m in metrics])
    if limit is not None:
        first = F.col(metrics[0].name)
        order = first.desc_nulls_last() if descending else first.asc_nulls_last()
        result = result.orderBy(order, *keys).limit(limit)
    return result


def _aggregate(m: Metric) -> Column:
    if m.aggregation == "count":
        return F.count(F.lit(1)) if m.column == "*" else F.count(F.expr(m.column))
    value = F.expr(m.column)
    if m.aggregation in ("sum", "percentage"):
        return F.sum(value)
    if m.aggregation in ("avg", "average"):
        return F.avg(value)
    if m.aggregation == "min":
        return F.min(value)
    if m.aggregation == "max":
        return F.max(value)
    raise ValueError(f"unknown aggregation: {m.aggregation}")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two results of the same grain side by side; NULL is a breakdown value too."""
    if not keys:
        names = right.columns
        one = right.select(F.struct(*names).alias("r")).scalar()
        return left.withColumn("_r", one).select(*left.columns, *[F.col("_r")[n].alias(n) for n in names])
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in keys])


def shape(df: DataFrame) -> tuple[str, list[str]]:
    """Index column (the first) and category columns (the rest) of a widget result."""
    return df.columns[0], df.columns[1:]


def dashboard(df: DataFrame, plan: DashboardPlan) -> dict[str, DataFrame]:
    """One lazy result per visualization of a plan, keyed by its title.

    Single-value kinds that share no breakdown are one aggregation each over the same filtered
    rows; the caller decides what to run. Only a limit that a visualization states cuts its rows.
    """
    by_name = {m.name: m for m in plan.metrics}
    single = {"number", "metric", "kpi", "stat", "gauge"}
    results = {}
    for viz in plan.visualizations:
        missing = [n for n in viz.metrics if n not in by_name]
        if missing:
            raise ValueError(f"the plan defines no metric named {missing}")
        title = viz.title or ", ".join(viz.metrics) + (f" by {viz.breakdown}" if viz.breakdown else "")
        results[title] = query(
            df,
            [by_name[n] for n in viz.metrics],
            None if viz.kind in single else viz.breakdown,
            plan.filters,
            plan.time,
            limit=None if viz.kind in single or not viz.breakdown else viz.limit,
        )
    return results


# ── joins along discovered relationships ─────────────────────────────────────


@dataclass(frozen=True)
class Edge:
    """``one.one_column`` is referenced by ``many.many_column``."""

    one: str
    one_column: str
    many: str
    many_column: str


def edges(relationships: DataFrame, min_confidence: float = 0.70) -> list[Edge]:
    """Relationship rows as edges. Metadata of one model, never table rows."""
    picked = relationships.filter(F.col("confidence") >= min_confidence).select(
        "from", "from_column", "to", "to_column"
    )
    return sorted((Edge(*row) for row in picked.collect()), key=lambda e: (e.many, e.many_column, e.one))


def path_to(graph: list[Edge], fact: str, dimension: str) -> list[Edge]:
    """Shortest many-to-one path from ``fact`` to ``dimension``.

    Only steps towards the one side are taken, so a path never multiplies fact rows. Two
    shortest paths are ambiguous and raise.
    """
    frontier: deque[tuple[str, list[Edge]]] = deque([(fact, [])])
    depth_of = {fact: 0}
    found: list[list[Edge]] = []
    while frontier:
        here, steps = frontier.popleft()
        if here == dimension:
            found.append(steps)
            continue
        if found and len(steps) >= len(found[0]):
            continue
        for e in graph:
            if e.many != here or depth_of.get(e.one, len(steps) + 1) < len(steps) + 1:
                continue
            depth_of[e.one] = len(steps) + 1
            frontier.append((e.one, [*steps, e]))
    shortest = [p for p in found if len(p) == len(found[0])]
    if not shortest:
        raise ValueError(f"no many-to-one path from {fact} to {dimension}")
    if len(shortest) > 1:
        raise ValueError(f"more than one shortest path from {fact} to {dimension}")
    return shortest[0]


def tree_to(graph: list[Edge], fact: str, dimensions: list[str]) -> list[Edge]:
    """The fewest many-to-one steps that lead from ``fact`` to all dimension tables, nearest first.

    A step that several dimensions share counts once, so the tree may pass a table that is on no shortest path. It is
    found by subsets of the dimensions: the best tree below a table for a subset is a step followed by the best
    tree there, or the union of the best trees for two parts of the subset. Two smallest trees are ambiguous and raise.
    """
    wanted = [d for d in dict.fromkeys(dimensions) if d != fact]
    tables = sorted({t for e in graph for t in (e.one, e.many)} | {fact, *wanted})
    full = (1 << len(wanted)) - 1
    # Per subset and table the smallest sets of steps; two are kept, which is enough to tell that they are ambiguous.
    best: list[dict[str, set[frozenset[Edge]]]] = [{t: {frozenset()} for t in tables}]

    def smallest(options: set[frozenset[Edge]]) -> set[frozenset[Edge]]:
        least = min(map(len, options))
        return set(sorted((o for o in options if len(o) == least), key=sorted_steps)[:2])

    def sorted_steps(o: frozenset[Edge]) -> list[tuple]:
        return sorted((e.many, e.many_column, e.one) for e in o)

    for subset in range(1, full + 1):
        found: dict[str, set[frozenset[Edge]]] = {}
        for t in tables:
            here = subset & ~sum(1 << i for i, d in enumerate(wanted) if d == t)
            options = set(best[here].get(t, ())) if here != subset else set()
            part = (subset - 1) & subset
            while part:
                options |= {a | b for a in best[part].get(t, ()) for b in best[subset & ~part].get(t, ())}
                part = (part - 1) & subset
            if options:
                found[t] = smallest(options)
        for _ in tables:
            for e in graph:
                if e.one in found:
                    options = found.get(e.many, set()) | {o | {e} for o in found[e.one]}
                    found[e.many] = smallest(options)
        best.append(found)
    trees = best[full].get(fact, set())
    if not trees:
        raise ValueError(f"no many-to-one steps from {fact} to {', '.join(wanted)}")
    (tree, *more) = trees
    twice = {e.one for e in tree for f in tree if e != f and e.one == f.one}
    if more or twice:
        raise ValueError(f"more than one smallest tree from {fact} to {', '.join(wanted)}")
    ordered, reached = [], [fact]
    for t in reached:
        steps = sorted((e for e in tree if e.many == t), key=lambda e: (e.many_column, e.one))
        ordered += steps
        reached += [e.one for e in steps]
    return ordered


def query_related(
    tables: dict[str, DataFrame],
    graph: list[Edge],
    metrics: dict[str, list[Metric]],
    breakdown: tuple[str, str] | list[tuple[str, str]],
    filters: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Metrics of one or several fact tables by columns of related tables, each given as (table, column).

    Each fact is first aggregated to the keys of its first steps and only then joined along the
    tree of steps to the breakdowns' tables, so the big table is shuffled once, as partial sums, and every join is followed
    by a grouping. Several facts are brought to the breakdowns' grain separately before they meet, which keeps one from
    inflating the other. A key of the one side that is not unique raises. Breakdowns of the same name get their table's
    name before it.
    """
    dims = [breakdown] if isinstance(breakdown, tuple) else list(breakdown)
    columns = [c for _, c in dims]
    names = [c if columns.count(c) == 1 else f"{t}_{c}" for t, c in dims]
    filters = filters or {}
    parts = []
    for fact, wanted in metrics.items():
        if any(m.aggregation not in ("sum", "count", "min", "max", "avg") for m in wanted):
            raise ValueError("only sum, count, min, max and avg can be joined along a path")
        steps = path_to(graph, fact, dims[0][0]) if len(dims) == 1 else tree_to(graph, fact, [t for t, _ in dims])

        def carried(t: str, steps: list[Edge] = steps) -> list[Column]:
            """What a table hands on: the keys of the steps from it and its breakdown columns."""
            keys = [F.col(e.many_column).alias(f"_key{i}") for i, e in enumerate(steps) if e.many == t]
            return keys + [F.col(c).alias(f"_dim{i}") for i, (d, c) in enumerate(dims) if d == t]

        rows = reduce(lambda d, c: d.filter(c), filters.get(fact, []), tables[fact])
        merged = rows.groupBy(*carried(fact)).agg(*[c for m in wanted for c in _partials(m)])
        for i, e in enumerate(steps):
            one = reduce(lambda d, c: d.filter(c), filters.get(e.one, []), tables[e.one])
            one = _once(one.select(F.col(e.one_column).alias("_one"), *carried(e.one)), e)
            merged = merged.join(one, F.col(f"_key{i}") == F.col("_one")).drop(f"_key{i}", "_one")
            kept = [c for c in merged.columns if c.startswith(("_key", "_dim"))]
            merged = merged.groupBy(*kept).agg(*[c for m in wanted for c in _regroup(m)])
        parts.append(
            merged.select(*[F.col(f"_dim{i}").alias(n) for i, n in enumerate(names)], *[_finish(m).alias(m.name) for m in wanted])
        )
    result = parts[0]
    for part in parts[1:]:
        values = [c for c in result.columns if c not in names] + [c for c in part.columns if c not in names]
        part = part.withColumnsRenamed({n: f"_right_{n}" for n in names})
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_right_{n}")) for n in names])
        result = result.join(part, same, "full").select(*[F.coalesce(n, f"_right_{n}").alias(n) for n in names], *values)
    return result


def _once(one: DataFrame, e: Edge) -> DataFrame:
    """The one side of a step, each key once; a key listed twice raises, as it would count its facts twice."""
    rest = [c for c in one.columns if c != "_one"]
    keys = one.filter(F.col("_one").isNotNull()).groupBy("_one").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_rest"))
    twice = F.raise_error(F.concat(F.lit(f"{e.one}.{e.one_column} is not unique: "), F.col("_one").cast("string")))
    return keys.select(F.when(F.col("_n") > 1, twice).otherwise(F.col("_one")).alias("_one"), "_rest.*")


def _partials(m: Metric) -> list[Column]:
    if m.aggregation == "avg":
        value = F.expr(m.column)
        return [F.sum(value).alias(f"_s_{m.name}"), F.count(value).alias(f"_n_{m.name}")]
    return [_aggregate(m).alias(f"_s_{m.name}")]


def _regroup(m: Metric) -> list[Column]:
    part = f"_s_{m.name}"
    if m.aggregation == "avg":
        return [F.sum(part).alias(part), F.sum(f"_n_{m.name}").alias(f"_n_{m.name}")]
    fold = {"min": F.min, "max": F.max}.get(m.aggregation, F.sum)
    return [fold(part).alias(part)]


def _finish(m: Metric) -> Column:
    if m.aggregation == "avg":
        return F.col(f"_s_{m.name}") / F.nullif(F.col(f"_n_{m.name}"), F.lit(0))
    return F.col(f"_s_{m.name}")
