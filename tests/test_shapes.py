import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siltstone.functions.sequences import with_next
from siltstone.operators import history as H
from siltstone.operators import preview
from siltstone.operators import shapes as S
from siltstone.plans import sql as Q


def test_comparison_values(spark):
    df = spark.createDataFrame([(124500.0, 98000.0), (5.0, 0.0), (5.0, -1.0)], "c double, p double")
    got = [round(r[0], 1) for r in df.select(S.comparison(F.col("c"), F.col("p"))).collect()]
    assert got == [27.0, 0.0, 0.0]


def test_period_change(spark):
    data = [(datetime(2024, 1, 1), 0.0), (datetime(2024, 2, 1), 10.0), (datetime(2024, 3, 1), 5.0)]
    df = spark.createDataFrame(data, "at timestamp_ntz, v double")
    change = lambda **k: [r.change_pct for r in S.period_change(df, "month", F.sum("v"), "at", **k).orderBy("period").collect()]
    assert change() == [None, 0.0, -50.0]
    assert change(guarded=False) == [None, None, -50.0]


def test_funnel_of_given_counts(spark):
    values = [10000, 5000, 2000, 800, 200]
    df = spark.createDataFrame([(i, f"s{i}", v) for i, v in enumerate(values)], "step int, stage string, value bigint")
    got = S.funnel_of_counts(df).orderBy("step").collect()
    assert [r.conversion for r in got] == [None, 50.0, 40.0, 40.0, 25.0]
    assert [r.width for r in got] == [100.0, 50.0, 20.0, 8.0, 2.0]


def test_funnel_counts_entities_once_and_missing_stages_as_zero(spark):
    df = spark.createDataFrame([("view", 1), ("view", 1), ("view", 2), ("buy", 1), ("other", 3)], "stage string, u int")
    got = S.funnel(df, "stage", "u", ["view", "cart", "buy"]).orderBy("step").collect()
    assert [(r.stage, r.value, r.conversion) for r in got] == [("view", 2, None), ("cart", 0, 0.0), ("buy", 1, None)]


def test_leaderboard_trend(spark):
    at = datetime(2024, 5, 10)
    data = [("a", 10.0, at), ("a", 5.0, at - timedelta(days=30)), ("b", 9.0, at - timedelta(days=30)), ("c", 1.0, at)]
    df = spark.createDataFrame(data, "e string, v double, at timestamp_ntz")
    got = S.leaderboard(df, "e", F.sum("v"), "at", "month", 2).orderBy("rank")
    assert [tuple(r) for r in got.collect()] == [(1, "a", 15.0, 100.0), (2, "b", 9.0, -100.0)]


def test_treemap_depth_and_null_level(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "z", 4)], "l string, m string, v int")
    got = S.treemap(df, ["l", "m"], F.sum("v"))
    assert rows(got) == sorted(
        [(None, None, 0, 7.0), ("a", None, 1, 3.0), (None, None, 1, 4.0), ("a", "x", 2, 1.0), ("a", None, 2, 2.0), (None, "z", 2, 4.0)],
        key=repr,
    )


def test_radar_of_equal_entities_and_share_of_nothing(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "e string, v double")
    assert rows(S.radar(df, "e", {"v": F.sum("v")})) == [("a", 0.0), ("b", 0.0)]
    assert rows(S.share(df, "e", F.sum("v"))) == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]


def test_sparkline_is_ordered(spark):
    data = [("a", float(i), datetime(2024, 1, 1) + timedelta(days=i)) for i in range(9)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "e string, v double, at timestamp_ntz")
    assert S.sparkline(df, "e", "at", "day", F.sum("v")).first().points == [float(i) for i in range(9)]


def test_successors_cross_slices_and_keep_null_values(spark):
    rng = random.Random(5)
    data = [
        (rng.choice(["hot", "hot", "hot", "b", None]), datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 200)), i, rng.choice(["x", "y", None]))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "k string, at timestamp_ntz, i int, v string")
    got = {r.i: r.n for r in with_next(df, "k", "at", "i", "v", "n").collect()}
    want: dict = {}
    for k in {d[0] for d in data}:
        chain = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))
        want |= {a[2]: b[3] for a, b in zip(chain, chain[1:])} | {chain[-1][2]: None}
    assert got == want


def test_heatmap_and_progress(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 9), 50.0), (datetime(2024, 1, 7, 9), 20.0)], "at timestamp_ntz, v double")
    assert rows(S.heatmap(df, "at", F.sum("v"), [9, 12])) == [(1, 0.5, 0.0), (7, 0.2, 0.0)]
    one = spark.range(1)
    assert one.select(S.progress(F.lit(50.0), F.lit(200.0)), S.progress(F.lit(9.0), F.lit(2.0))).first() == (25.0, 100.0)


def test_last_n_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(50)], "g int, i int")
    last = H.last_n(df, "g", "i", 3)
    # Read before running: a finished adaptive plan is printed together with its first version.
    planned = last._jdf.queryExecution().executedPlan().toString()
    assert planned.count("WindowGroupLimit") == 2
    assert rows(last) == [(1, 47), (1, 48), (1, 49), (2, 47), (2, 48), (2, 49)]
    assert rows(H.latest(df, "g", ["i"])) == [(1, 49), (2, 49)]


def test_effective_status(spark):
    configs = spark.createDataFrame(
        [("gone", "success", 9, "e"), ("ok", "success", 9, "e"), ("bad", "failed", 3, "boom"), ("busy", "failed", 3, "x"), ("new", None, None, None)],
        "source string, status string, rows_cached int, error string",
    ).withColumn("last_sync_at", F.lit(datetime(2024, 1, 1)))
    stored = spark.createDataFrame([("ok", ["t"]), ("bad", []), ("busy", ["u"])], "source string, tables array<string>")
    running = spark.createDataFrame([("busy",)], "source string")
    got = {r.source: r for r in H.sync_status(configs, stored, running).collect()}
    assert {s: r.status for s, r in got.items()} == {"gone": "never", "ok": "success", "bad": "failed", "busy": "running", "new": "never"}
    assert (got["gone"].rows_cached, got["gone"].last_sync_at, got["gone"].error) == (0, None, H.NO_CACHE)
    assert got["ok"].error is None and got["bad"].error == "boom" and got["ok"].tables_cached == ["t"]


def test_search_and_pages(spark):
    df = spark.createDataFrame([(i, f"Name {i}", [f"t{i}"], None) for i in range(30)], "i int, n string, l array<string>, z string")
    assert rows(preview.search(df, "NAME 1").select("i"))[:2] == [(1,), (10,)]
    assert rows(preview.search(df, "t29").select("i")) == [(29,)]
    assert preview.search(df, "100%").count() == 0
    page = preview.page(df.select("i"), ["i"], 5, 10)
    assert rows(page, "kept") == [(i,) for i in range(10, 15)]
    assert rows(preview.page(df.select("i"), ["i"], 5, after=(9,)), "kept") == rows(page, "kept")
    assert rows(preview.table(df.select("i"), ["i"], True, 2), "kept") == [(29,), (28,)]


@pytest.mark.parametrize("asked, shown", [(None, 7000), (10, 10), (6000, 6000), (200_000, 7000)])
def test_result_limits(spark, asked, shown):
    assert Q.limited(spark.range(7000), asked).count() == shown


def test_queries_are_logged(spark, tmp_path):
    Q.register({"a.nums": spark.range(5)})
    out = Q.run_logged(spark, "a", "SELECT * FROM a__nums WHERE id > 1", str(tmp_path / "log"), str(tmp_path / "r"))
    assert out.count() == 3
    with pytest.raises(Exception):
        Q.run_logged(spark, "a", "SELECT nope FROM a__nums", str(tmp_path / "log"), str(tmp_path / "r2"))
    log = H.queries(spark.read.parquet(str(tmp_path / "log")), "a").collect()
    assert [(r.status, r.rows) for r in log] == [("failed", 0), ("success", 3)]
    assert H.queries(spark.read.parquet(str(tmp_path / "log")), "b").count() == 0
