"""Joins by time, sessions, merged profiles, bucketed upserts and shared scans."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siltstone.operators import buckets as B
from siltstone.operators import sketches as K
from siltstone.operators import temporal as J
from siltstone.plans import metrics as m
from siltstone.plans import shared_scan as S
from siltstone.plans.metrics import DashboardPlan, Metric, Visualization
from siltstone.streaming import stream as ST

DAY = 86_400_000_000
START = datetime(2024, 1, 1)


def moments(draw, n, hot):
    """Rows (id, key, time, value); a third of them share a key, some lack key or time."""
    out = []
    for i in range(n):
        key = 1 if draw.random() < hot else draw.choice([2, 3, 4, None])
        at = None if draw.random() < 0.05 else START + timedelta(hours=draw.randrange(24 * 40))
        out.append((i, key, at, draw.randrange(100)))
    return out


def test_as_of_is_brute_force(spark):
    draw = random.Random(5)
    left, right = moments(draw, 300, 0.4), moments(draw, 200, 0.4)
    got = J.as_of(
        spark.createDataFrame(left, "id int, k int, at timestamp_ntz, v int"),
        spark.createDataFrame(right, "rid int, k int, rat timestamp_ntz, v int").withColumnRenamed("k", "k"),
        ["k"], "at", "rat", ["rid", "v"], 3 * DAY, tie="rid", prefix="right_",
    )
    wanted = []
    for i, k, at, v in left:
        found = [(t, r, w) for r, j, t, w in right if None not in (k, at, j, t) and j == k and t <= at]
        best = max(found) if found else (None, None, None)
        wanted.append((i, k, at, v, best[1], best[2]))
    assert rows(got) == sorted(wanted, key=repr)
    assert got.columns == ["id", "k", "at", "v", "right_rid", "right_v"]


def test_as_of_deals_a_hot_key_into_slices(spark):
    one = spark.range(10_000).select(F.lit(1).alias("k"), (F.lit(START) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("at"), "id")
    plan = J.as_of(one, one, ["k"], "at", "at", ["id"], DAY // 24, prefix="r_")
    assert plan.filter("r_id != id").count() == 0
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    # Only the heads, one a slice, meet in a window over the whole key.
    assert len(windows) == 2 and sum("_slice" in w.split("],")[1] for w in windows) == 1


def test_as_of_without_rows(spark):
    none = spark.createDataFrame([], "k int, at timestamp_ntz, x int")
    some = spark.createDataFrame([(1, START, 7)], "k int, at timestamp_ntz, x int")
    assert J.as_of(none, some, ["k"], "at", "at", ["x"], DAY, prefix="r_").count() == 0
    assert rows(J.as_of(some, none, ["k"], "at", "at", ["x"], DAY, prefix="r_")) == [(1, START, 7, None)]


@pytest.mark.parametrize("hot", [0.3, 1.0])
def test_overlaps_are_brute_force(spark, hot):
    draw = random.Random(8)

    def spans(n):
        out = []
        for i, k, at, _ in moments(draw, n, hot):
            end = None if at is None else at + timedelta(seconds=draw.choice([-5, 0, 1, 3600, 86_400 * 3, 86_400 * 400]) + draw.randrange(600))
            out.append((i, k, at, end))
        return out

    left, right = spans(120), spans(140)
    schema = "id int, k int, a timestamp_ntz, b timestamp_ntz"
    got = J.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ("a", "b"), ("a", "b"))
    fine = lambda r: None not in r and r[2] <= r[3]
    wanted = [(x[0], y[0]) for x in left for y in right if fine(x) and fine(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]]
    assert rows(got.select("l.id", "r.id")) == sorted(wanted, key=repr)


def test_sessions_close_and_late_rows_go(spark, tmp_path):
    schema = "user int, ts timestamp, v int"
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [(1, at(0), 1), (1, at(5), 2), (2, at(3), 4), (3, None, 9)],
        [(1, at(12), 8), (2, at(40), 16)],
        [(1, at(90), 32), (1, at(14), 64)],  # the second is late: the watermark stands at 30 minutes
        [(4, at(300), 128)],
    ]
    source = tmp_path / "in"
    measures = {"n": F.count(F.lit(1)), "total": F.sum("v")}
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        found = ST.sessions(ST.read_files(spark, str(source), schema), ["user"], "ts", "10 minutes", "10 minutes", measures)
        ST.keep_sessions(found, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("user", "started", "ended", "n", "total")) == sorted(
        [(1, at(0), at(22), 3, 11), (2, at(3), at(13), 1, 4), (2, at(40), at(50), 1, 16), (1, at(90), at(100), 1, 32)], key=repr
    )
    once = ST.sessions(spark.read.schema(schema).parquet(str(source)), ["user"], "ts", "10 minutes", "10 minutes", measures)
    assert rows(once.filter("user = 1 AND ended < timestamp'2024-01-01 01:00:00'").select("n", "total")) == [(4, 75)]


def test_profiles_merge(spark, tmp_path):
    at = str(tmp_path / "p")
    first = spark.range(20_000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("v"), F.col("id").cast("string").alias("t"))
    K.add(first, at)
    K.add(first.filter("id < 0"), at)
    K.add(spark.range(20_000, 30_000).select("id", F.lit(99).cast("long").alias("v"), F.lit("z").alias("t"), F.array("id").alias("more")), at)
    got = {r["column_name"]: r for r in K.profile(spark, at, "x").collect()}
    assert [got[c]["row_count"] for c in ("id", "v", "t", "more")] == [30_000] * 4
    assert (got["id"]["min"], got["id"]["max"], got["v"]["max"], got["t"]["max"]) == ("0", "29999", "99", "z")
    assert got["v"]["null_percentage"] == round(5000 / 30_000 * 100, 2) and got["more"]["null_percentage"] == round(20_000 / 30_000 * 100, 2)
    for name, true in (("id", 30_000), ("v", 51), ("t", 20_001), ("more", 10_000)):
        assert abs(got[name]["cardinality"] - true) <= K.DISTINCT_BOUND * true
    assert abs(got["id"]["median"] - 15_000) <= K.RANK_BOUND * 30_000
    assert K.segments(spark, at).count() == 3
    with pytest.raises(ValueError):
        K.profile(spark, str(tmp_path / "none"), "x")


def test_a_profile_reads_no_data(spark, tmp_path):
    at = str(tmp_path / "p")
    K.add(spark.range(100).toDF("a"), at)
    assert all("/p/" in f for f in K.profile(spark, at, "x").inputFiles())


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_an_upsert_leaves_other_partitions_alone(spark, tmp_path):
    at = str(tmp_path / "t")
    base = spark.range(1000).select("id", (F.col("id") % 10).alias("ver"), F.lit("a").alias("x"))
    B.create(base.unionByName(base.limit(3)), at, ["id"], 32, "ver")
    before = files_of(f"{at}/rows")
    change = spark.createDataFrame([(5, 3, "older"), (6, 6, "same"), (7, 70, "newer"), (5000, 1, "added"), (None, 1, "bare")], "id long, ver long, x string")
    touched = B.upsert(change, at)
    after = files_of(f"{at}/rows")
    untouched = {f for f in before if int(Path(f).parent.name.split("=")[1]) not in touched}
    assert len(untouched) >= 27 and all(before[f] == after[f] for f in untouched)
    got = {r["id"]: (r["ver"], r["x"]) for r in B.read(spark, at).collect()}
    assert len(got) == 1002 and [got[i] for i in (5, 6, 7, 5000, None)] == [(5, "a"), (6, "same"), (70, "newer"), (1, "added"), (1, "bare")]
    # The same increment again changes nothing, rows without a key included.
    B.upsert(change, at)
    assert rows(B.read(spark, at)) == sorted([(i, *v) for i, v in got.items()], key=repr)
    assert B.upsert(change.limit(0), at) == []
    with pytest.raises(ValueError):
        B.create(base, at, ["id"], 8)


def test_a_column_read_is_a_column_scan(spark, tmp_path):
    at = str(tmp_path / "t")
    B.create(spark.range(100).select("id", F.lit(1).alias("a"), F.lit("x").alias("b")), at, ["id"], 8)
    B.upsert(spark.createDataFrame([(1, 2, "y", True)], "id long, a int, b string, c boolean"), at)
    plan = B.read(spark, at).select("a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<a:int>" in plan
    assert rows(B.lookup(spark, at, {"id": 1})) == [(1, 2, "y", True)] and B.lookup(spark, at, {"id": 2}).count() == 1
    scan = B.lookup(spark, at, {"id": 1})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in scan


def test_one_scan_for_a_plan(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", "x", 1.0, 1), ("a", "y", 2.0, None), ("b", "x", 3.0, 5), (None, "x", 4.0, 7), ("b", None, None, 9)],
        "g string, h string, v double, n int",
    )
    metrics = [
        Metric("total", "sum", "v"), Metric("rows", "count"), Metric("mean", "average", "v"), Metric("share", "percentage", "v"),
        Metric("low", "min", "n"), Metric("mid", "median", "v"),
    ]
    plan = DashboardPlan("t", metrics, [
        Visualization("number", ["total", "rows", "mean"], title="all"),
        Visualization("bar", ["total", "low"], "g", title="by g"),
        Visualization("pie", ["share"], "h", title="by h"),
        Visualization("bar", ["total"], "g", title="top", limit=1),
        Visualization("bar", ["mid"], "g", title="median"),
    ])
    found, alone = S.dashboard(df, plan, str(tmp_path / "d")), m.dashboard(df, plan)
    assert list(found) == list(alone)
    for title in alone:
        assert rows(found[title]) == rows(alone[title]), title
    empty = S.dashboard(df.limit(0), plan, str(tmp_path / "e"))
    assert rows(empty["all"]) == [(None, 0, None)] and empty["by g"].count() == 0


def test_fused_groupings_scan_once(spark, tmp_path):
    spark.range(50).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), "id").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    sets = {"all": [], "a": ["a"], "b": ["b"], "ab": ["b", "a"]}
    one = S.fused(df, sets, {"n": F.count(F.lit(1)), "s": F.sum("id")})
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = S.grouped(df, sets, {"n": F.count(F.lit(1)), "s": F.sum("id")}, str(tmp_path / "out"))
    for name, keys in sets.items():
        assert rows(found[name]) == rows(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")))
