"""Several grouped results of one table by one scan.

All groupings are one GROUPING SETS aggregation, which combines in each task before it shuffles. Its result,
which has a row per group and never one per input row, is written once, dealt by grouping, and each result reads its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.metrics import DashboardPlan, Metric, Visualization, _finish, _partials, date_range, query


def fused(df: DataFrame, sets: dict[str, list[str]], measures: dict[str, Column]) -> DataFrame:
    """One row per group of each grouping: ``_set`` (a number, see ``set_ids``), all keys and the measures."""
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    columns = [c.alias(n) for n, c in measures.items()]
    if not keys:
        return df.groupBy().agg(F.lit(0).cast("long").alias("_set"), *columns)
    groupings = [list(s) for s in dict.fromkeys(tuple(k for k in keys if k in s) for s in sets.values())]
    return df.groupingSets(groupings, *keys).agg(F.grouping_id().alias("_set"), *columns)


def set_ids(sets: dict[str, list[str]]) -> dict[str, int]:
    """The number of each grouping: a bit for each key of the others that it leaves out."""
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    return {n: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for n, s in sets.items()}


def grouped(df: DataFrame, sets: dict[str, list[str]], measures: dict[str, Column], folder: str) -> dict[str, DataFrame]:
    """The result of each grouping by name, with its keys and all measures. ``df`` is read once, now."""
    one = fused(df, sets, measures)
    one.write.partitionBy("_set").parquet(folder)
    found = df.sparkSession.read.schema(one.schema).parquet(folder)
    ids = set_ids(sets)
    return {n: found.filter(F.col("_set") == ids[n]).select(*s, *measures) for n, s in sets.items()}


def dashboard(df: DataFrame, plan: DashboardPlan, folder: str) -> dict[str, DataFrame]:
    """What ``metrics.dashboard`` returns, with one scan for all visualizations that have neither medians nor plain rows.

    Those others are lazy results of their own, as there.
    """
    by_name = {m.name: m for m in plan.metrics}
    missing = [n for v in plan.visualizations for n in v.metrics if n not in by_name]
    if missing:
        raise ValueError(f"the plan defines no metric named {missing}")
    rows = df if plan.time is None else date_range(df, plan.time)
    for condition in plan.filters:
        rows = rows.filter(condition)
    own = [v for v in plan.visualizations if any(by_name[n].aggregation in ("median", "none") for n in v.metrics)]
    shared = [v for v in plan.visualizations if v not in own]
    sets = {_title(v): [] if _is_single(v) else [v.breakdown] for v in shared}
    wanted = [by_name[n] for n in dict.fromkeys(n for v in shared for n in v.metrics)]
    partial = {name: c for m in wanted for name, c in zip(_names(m), _partials(_summed(m)))}
    results = {}
    if shared:
        parts = grouped(rows, sets, partial, folder)
        for v in shared:
            metrics, keys = [by_name[n] for n in v.metrics], sets[_title(v)]
            part = parts[_title(v)]
            if not keys:
                # A row even where there are no rows; counts are then 0.
                part = part.agg(*[(F.coalesce(F.max(n), F.lit(0)) if _counts(n, metrics) else F.max(n)).alias(n) for m in metrics for n in _names(m)])
            results[_title(v)] = _shown(part, keys, metrics, None if _is_single(v) or not v.breakdown else v.limit)
    for v in own:
        limit = None if _is_single(v) or not v.breakdown else v.limit
        results[_title(v)] = query(rows, [by_name[n] for n in v.metrics], None if _is_single(v) else v.breakdown, limit=limit)
    return {_title(v): results[_title(v)] for v in plan.visualizations}


def _title(v: Visualization) -> str:
    return v.title or ", ".join(v.metrics) + (f" by {v.breakdown}" if v.breakdown else "")


def _is_single(v: Visualization) -> bool:
    return v.breakdown is None or v.kind in {"number", "metric", "kpi", "stat", "gauge"}


def _summed(m: Metric) -> Metric:
    """The metric whose partial results can be finished: a mean as a sum and a count."""
    return Metric(m.name, "avg", m.column) if m.aggregation == "average" else m


def _names(m: Metric) -> list[str]:
    return [f"_s_{m.name}", f"_n_{m.name}"] if m.aggregation in ("avg", "average") else [f"_s_{m.name}"]


def _counts(name: str, metrics: list[Metric]) -> bool:
    return name.startswith("_n_") or any(m.aggregation == "count" and name == f"_s_{m.name}" for m in metrics)


def _shown(part: DataFrame, keys: list[str], metrics: list[Metric], limit: int | None) -> DataFrame:
    columns = []
    for m in metrics:
        value = _finish(_summed(m))
        if m.aggregation == "percentage":
            value = value.cast("double") / part.agg(F.sum(f"_s_{m.name}")).scalar().cast("double") * 100
        columns.append(value.alias(m.name))
    out = part.select(*keys, *columns)
    return out if limit is None else out.orderBy(F.col(metrics[0].name).desc_nulls_last(), *keys).limit(limit)
