"""Deep pages and positions against a sort of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from siltstone.operators import fences


def mixed(spark, n=3000):
    rnd = random.Random(5)
    # A third of all rows shares one leading value, some have none.
    data = [(None if i % 50 == 0 else 7 if i % 3 == 0 else rnd.randrange(100), f"k{rnd.randrange(10**6):06d}{i}", i) for i in range(n)]
    return data, spark.createDataFrame(data, "a int, `b c` string, i int")


def sort_key(row):
    return (row[0] is not None, row[0] or 0, row[1])


@pytest.mark.parametrize("descending", [False, True])
def test_pages_equal_a_sort(spark, tmp_path, descending):
    data, df = mixed(spark)
    at = f"{tmp_path}/with space"
    fences.write(df, at, ["a", "b c"], descending, range_rows=200)
    want = sorted(data, key=sort_key, reverse=descending)
    index = fences.fences(spark, at)
    assert index.count() == 15 and index.agg(F.sum("rows"), F.max("rows")).first()[0] == 3000
    for offset, limit in ((0, 10), (195, 30), (1234, 600), (2990, 50), (3000, 5), (10**9, 5)):
        got = [tuple(r) for r in fences.page(spark, at, ["a", "b c"], limit, offset).collect()]
        assert got == want[offset : offset + limit]
    for k in (0, 17, 1500, 2999):
        assert fences.position(spark, at, ["a", "b c"], want[k][:2]).first()[0] == k
    # Values of no row.
    between = sum(sort_key(r) > sort_key((7, "zz")) if descending else sort_key(r) < sort_key((7, "zz")) for r in data)
    assert fences.position(spark, at, ["a", "b c"], (7, "zz")).first()[0] == between
    assert fences.position(spark, at, ["a", "b c"], (-1, "")).first()[0] == (2940 if descending else 60)


def test_a_page_opens_its_ranges_only(spark, tmp_path):
    _, df = mixed(spark)
    fences.write(df, f"{tmp_path}/t", ["a", "b c"], range_rows=200)
    got = fences.page(spark, f"{tmp_path}/t", ["a", "b c"], 20, 2000)
    held = fences.fences(spark, f"{tmp_path}/t").filter("before < 2020 AND before + rows > 2000").count()
    assert len(got.inputFiles()) == held <= 2
    assert "Exchange rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_hot_value_is_spread(spark, tmp_path):
    _, df = mixed(spark)
    fences.write(df, f"{tmp_path}/t", ["a", "b c"], range_rows=200)
    assert fences.fences(spark, f"{tmp_path}/t").filter("first.v0 <= 7 AND last.v0 >= 7").count() >= 5
    assert fences.fences(spark, f"{tmp_path}/t").agg(F.max("rows")).first()[0] < 600


def test_empty_table_and_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], "a int, b string")
    fences.write(none, f"{tmp_path}/none", ["a"])
    assert fences.page(spark, f"{tmp_path}/none", ["a"], 5).collect() == []
    assert fences.position(spark, f"{tmp_path}/none", ["a"], (1,)).first()[0] == 0
    same = spark.range(500).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    fences.write(same, f"{tmp_path}/same", ["a"], range_rows=50)
    assert rows(fences.page(spark, f"{tmp_path}/same", ["a"], 3, 498)) == [(1, "x")] * 2
    with pytest.raises(ValueError, match="there already"):
        fences.write(same, f"{tmp_path}/same", ["a"])


@pytest.mark.parametrize("descending", [False, True])
def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch, descending):
    """One task sorts many ranges: the driver's samples and results grow with the tasks."""
    monkeypatch.setattr(fences, "TASK_ROWS", 800)
    frame, dealt = type(spark.range(0)), []
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *by: dealt.append(n) or deal(self, n, *by))
    data, df = mixed(spark)
    fences.write(df, f"{tmp_path}/t", ["a", "b c"], descending, range_rows=50)
    assert dealt == [4]
    index = fences.fences(spark, f"{tmp_path}/t").orderBy("range").collect()
    assert 60 <= len(index) <= 64 and max(r.rows for r in index) == 50 and all(len(r.files) == 1 for r in index)
    assert [r.before for r in index] == [sum(r.rows for r in index[:i]) for i in range(len(index))]
    want = sorted(data, key=sort_key, reverse=descending)
    for offset, limit in ((0, 10), (49, 2), (745, 120), (2990, 50)):
        got = fences.page(spark, f"{tmp_path}/t", ["a", "b c"], limit, offset)
        assert [tuple(r) for r in got.collect()] == want[offset : offset + limit]
        # The last range of a task may be short.
        assert len(got.inputFiles()) <= limit // 50 + 3
    for k in (0, 49, 50, 799, 800, 2999):
        assert fences.position(spark, f"{tmp_path}/t", ["a", "b c"], want[k][:2]).first()[0] == k


def test_equal_rows_over_several_ranges(spark, tmp_path):
    df = spark.range(500).selectExpr("IF(id < 100, 0, IF(id < 400, 1, 2)) AS a", "id")
    fences.write(df, f"{tmp_path}/t", ["a"], range_rows=30)
    assert fences.fences(spark, f"{tmp_path}/t").filter("first.v0 = 1").count() > 5
    for value, before in ((-1, 0), (0, 0), (1, 100), (2, 400), (3, 500)):
        assert fences.position(spark, f"{tmp_path}/t", ["a"], (value,)).first()[0] == before
    pages = [r.id for k in range(0, 500, 45) for r in fences.page(spark, f"{tmp_path}/t", ["a"], 45, k).collect()]
    assert sorted(pages) == list(range(500))


def test_a_range_of_a_tasks_size_is_not_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fences, "TASK_ROWS", 300)
    _, df = mixed(spark)
    fences.write(df, f"{tmp_path}/t", ["a", "b c"], range_rows=300)
    index = fences.fences(spark, f"{tmp_path}/t").agg(F.count("*"), F.sum("rows")).first()
    assert index[0] <= 10 and index[1] == 3000
