import random
import statistics
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siltstone.functions.quantiles import exact_median
from siltstone.plans import dashboards as d
from siltstone.plans import metrics as m
from siltstone.plans.metrics import DashboardPlan, Edge, Metric, TimeRange, Visualization


@pytest.fixture
def sales(spark):
    data = [("a", 1.0, datetime(2024, 1, 1)), ("a", 3.0, datetime(2024, 3, 30)), ("b", 6.0, datetime(2024, 3, 31)), (None, 10.0, datetime(2023, 1, 1))]
    return spark.createDataFrame(data, "k string, v double, at timestamp_ntz")


def test_aggregations_with_and_without_breakdown(sales):
    kinds = ["sum", "avg", "average", "count", "min", "max", "median", "percentage"]
    metrics = [Metric(k, k, "v") for k in kinds]
    assert m.query(sales, metrics).first() == (20.0, 5.0, 5.0, 4, 1.0, 10.0, 4.5, 100.0)
    got = {r.k: tuple(r)[1:] for r in m.query(sales, metrics, "k").collect()}
    assert got["a"] == (4.0, 2.0, 2.0, 2, 1.0, 3.0, 2.0, 20.0)
    assert got[None] == (10.0, 10.0, 10.0, 1, 10.0, 10.0, 10.0, 50.0)
    assert m.shape(m.query(sales, metrics, "k")) == ("k", kinds)


def test_rows_without_aggregation_and_errors(sales):
    assert rows(m.query(sales, [Metric("twice", "none", "v * 2")], "k", ["v < 5"])) == [("a", 2.0), ("a", 6.0)]
    with pytest.raises(ValueError):
        m.query(sales, [Metric("x", "none", "v"), Metric("n", "count")])
    with pytest.raises(ValueError):
        m.query(sales, [Metric("x", "mode", "v")])


def test_limit_is_by_first_metric(sales):
    top = m.query(sales, [Metric("s", "sum", "v")], "k", limit=2)
    assert rows(top, "kept") == [(None, 10.0), ("b", 6.0)]
    assert rows(m.query(sales, [Metric("s", "sum", "v")], "k", descending=False, limit=1)) == [("a", 4.0)]


@pytest.mark.parametrize(
    "time, count",
    [
        (TimeRange("at"), 4),
        (TimeRange("at", "All time"), 4),
        (TimeRange("at", "7d"), 2),
        (TimeRange("at", "Last 90 Days"), 3),
        (TimeRange("at", "90d", anchor="2024-04-05"), 2),
        (TimeRange("at", "365d"), 3),
        (TimeRange("at", "mtd"), 2),
        (TimeRange("at", "ytd"), 3),
        (TimeRange("at", "ytd", anchor="2024-03-30"), 2),
        (TimeRange("at", "custom", start="2024-01-01", end="2024-03-30"), 2),
        (TimeRange("at", "custom", end="2023-12-31"), 1),
    ],
)
def test_date_ranges(sales, time, count):
    assert m.date_range(sales, time).count() == count


def test_bad_ranges(sales):
    with pytest.raises(ValueError):
        m.date_range(sales, TimeRange("at", "custom"))
    with pytest.raises(ValueError):
        m.date_range(sales, TimeRange("at", "fortnight"))


def test_time_filter_reaches_the_scan(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    query = m.query(df, [Metric("s", "sum", "v")], "k", time=TimeRange("at", "30d", anchor="2024-03-31"))
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at," in plan and "ReadSchema: struct<k:string,v:double,at:timestamp_ntz>" in plan


def test_median_equals_brute_force_on_hot_groups(spark):
    rng = random.Random(3)
    data = [("hot", float(rng.randint(0, 5000))) for _ in range(30_001)]
    data += [("same", 7.0)] * 5000 + [("two", 1.0), ("two", 2.0), ("one", -3.5), ("none", None)]
    data += [(None, 4.0), (None, 8.0), (None, 5.0)] + [("steps", v) for v in [1.0] * 50 + [2.0] * 50]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r.k: r.m for r in exact_median(df, ["k"], F.col("v"), "m").collect()}
    groups: dict = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    total = exact_median(df, [], F.col("v"), "m").first().m
    assert total == statistics.median([v for _, v in data if v is not None])


def test_plan_dashboard(sales):
    plan = DashboardPlan(
        "d", [Metric("s", "sum", "v"), Metric("n", "count")],
        [Visualization("number", ["s"]), Visualization("bar", ["s", "n"], "k"), Visualization("kpi", ["n"], "k", "all")],
        TimeRange("at", "ytd"), ["v > 1"],
    )
    w = m.dashboard(sales, plan)
    assert list(w) == ["s", "s, n by k", "all"]
    assert w["s"].first() == (9.0,) and rows(w["s, n by k"]) == [("a", 3.0, 1), ("b", 6.0, 1)] and w["all"].first() == (2,)
    with pytest.raises(ValueError):
        m.dashboard(sales, DashboardPlan("d", [], [Visualization("bar", ["s"])]))


GRAPH = [Edge("c", "id", "o", "c_id"), Edge("o", "id", "l", "o_id"), Edge("r", "id", "c", "r_id")]


def test_paths():
    assert [e.one for e in m.path_to(GRAPH, "l", "r")] == ["o", "c", "r"]
    assert m.path_to(GRAPH, "l", "l") == []
    with pytest.raises(ValueError, match="no many-to-one path"):
        m.path_to(GRAPH, "r", "l")
    two = [*GRAPH, Edge("r", "id", "o", "r_id"), Edge("r", "id", "o", "r2_id")]
    with pytest.raises(ValueError, match="more than one"):
        m.path_to(two, "o", "r")


def test_two_facts_do_not_inflate_each_other(spark):
    tables = {
        "r": spark.createDataFrame([(1, "east"), (2, "west"), (3, "none")], "id int, name string"),
        "c": spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id int, r_id int"),
        "o": spark.createDataFrame([(100, 10, 5.0), (101, 10, 6.0), (102, 11, 7.0)], "id int, c_id int, amount double"),
    }
    got = m.query_related(
        tables, GRAPH,
        {"o": [Metric("total", "sum", "amount"), Metric("mean", "avg", "amount")], "c": [Metric("customers", "count")]},
        ("r", "name"), {"o": ["amount > 5"]},
    )
    assert rows(got) == [("east", 13.0, 6.5, 2), ("west", None, None, 1)]
    with pytest.raises(ValueError):
        m.query_related(tables, GRAPH, {"o": [Metric("x", "median", "amount")]}, ("r", "name"))


def test_edges_from_relationships(spark):
    rel = spark.createDataFrame(
        [("c", "id", "o", "c_id", 0.9), ("x", "id", "o", "x_id", 0.5)],
        "`from` string, from_column string, `to` string, to_column string, confidence double",
    )
    assert m.edges(rel) == [Edge("c", "id", "o", "c_id")]


COLUMNS = d.OrderColumns("id", "cust", "amount", "at", "status", "pay", "cid", "name", "state")


def test_dashboard_drops_cancelled_and_null_status(spark, tmp_path):
    orders = spark.createDataFrame(
        [(1, 1, 10.0, datetime(2024, 1, 5), "done", "card"), (2, 1, 5.0, datetime(2024, 2, 5), "cancelled", "card"),
         (3, 2, 7.0, datetime(2024, 2, 6), None, "cash"), (4, 9, 1.0, datetime(2024, 3, 1), "done", "cash")],
        "id int, cust int, amount double, at timestamp_ntz, status string, pay string",
    )
    customers = spark.createDataFrame([(1, "Ann", "X"), (2, "Bo", "Y")], "cid int, name string, state string")
    w = d.command_center(orders, customers, COLUMNS, str(tmp_path / "w"))
    assert w["kpis"].first() == (11.0, 5.5, 4, 2)
    assert rows(w["revenue_trend"], "kept") == [("Jan 2024", 10.0), ("Mar 2024", 1.0)]
    assert rows(w["top_customers"]) == [("Ann", 10.0, 1)]
    assert rows(w["revenue_by_payment"], "kept") == [("card", 10.0), ("cash", 1.0)]
    assert [r.id for r in w["recent_orders"].collect()] == [3, 2, 1]
    assert rows(w["customers_by_region"]) == [("X", 1), ("Y", 1)]


def test_the_smallest_tree_shares_steps():
    graph = [
        Edge("a", "id", "fact", "a_id"), Edge("b", "id", "fact", "b_id"), Edge("hub", "id", "fact", "hub_id"),
        Edge("mid", "id", "hub", "mid_id"), Edge("x", "id", "mid", "x_id"), Edge("y", "id", "mid", "y_id"),
        Edge("z", "id", "mid", "z_id"), Edge("x", "id", "a", "x_id"), Edge("y", "id", "b", "y_id"), Edge("fact", "id", "fact", "up_id"),
    ]
    steps = lambda *d: [(e.many, e.one) for e in m.tree_to(graph, "fact", list(d))]
    assert steps("x") == [("fact", "a"), ("a", "x")]
    assert steps("x", "y", "z") == [("fact", "hub"), ("hub", "mid"), ("mid", "x"), ("mid", "y"), ("mid", "z")]
    assert steps("fact", "hub") == [("fact", "hub")] and steps("fact") == []
    for dims in (["x", "y"], ["nowhere"]):  # two trees of four steps; no way there
        with pytest.raises(ValueError):
            m.tree_to(graph, "fact", dims)


def test_two_breakdowns_of_one_name(spark):
    tables = {
        "r": spark.createDataFrame([(1, "east"), (2, None)], "id int, name string"),
        "c": spark.createDataFrame([(10, 1, "ann"), (11, 1, "bo"), (12, 2, "bo")], "id int, r_id int, name string"),
        "o": spark.createDataFrame([(100, 10, 5.0), (101, 10, 6.0), (102, 11, 7.0), (103, 12, 1.0), (104, 12, None)], "id int, c_id int, amount double"),
    }
    metrics = {"o": [Metric("total", "sum", "amount"), Metric("mean", "avg", "amount")], "c": [Metric("customers", "count")]}
    got = m.query_related(tables, GRAPH, metrics, [("r", "name"), ("c", "name")])
    assert got.columns == ["r_name", "c_name", "total", "mean", "customers"]
    assert rows(got) == sorted([("east", "ann", 11.0, 5.5, 1), ("east", "bo", 7.0, 7.0, 1), (None, "bo", 1.0, 1.0, 1)], key=repr)
