import pytest
from pyspark.sql import types as T

from siltstone.operators import drift


def schema(ddl):
    return T.StructType.fromDDL(ddl)


def test_first_version_and_no_change(spark):
    assert drift.changes(None, schema("a int"), "t") == []
    assert drift.changes(schema("a int"), schema("a int"), "t") == []


def test_added_removed_retyped(spark):
    got = drift.changes(schema("a int, b string, c int"), schema("a int, c string, d double"), "t")
    assert got == [
        ("t", "b", "column_removed", "VARCHAR", None, True),
        ("t", "c", "type_changed", "INTEGER", "VARCHAR", True),
        ("t", "d", "column_added", None, "DOUBLE", False),
    ]


def test_nested_fields_are_compared_by_path(spark):
    old = schema("s struct<x: int, y: array<struct<z: int>>>")
    new = schema("s struct<x: int, y: array<struct<z: string, w: int>>>")
    got = [(c[1], c[2]) for c in drift.changes(old, new, "t")]
    assert got == [("s.y[].w", "column_added"), ("s.y[].z", "type_changed")]


def test_freeze_refuses_only_changes_that_need_review(spark):
    assert len(drift.check(schema("a int"), schema("a int, b int"), "t", "freeze")) == 1
    with pytest.raises(drift.SchemaFrozen, match="a \\(type_changed\\)"):
        drift.check(schema("a int"), schema("a string"), "t", "freeze")


def test_detect_as_frame(spark):
    df = drift.detect(spark, schema("a int"), schema("b int"), "t")
    assert {(r.column_name, r.requires_review) for r in df.collect()} == {("a", True), ("b", False)}
    assert drift.detect(spark, None, schema("a int"), "t").count() == 0


def test_renamed_columns(spark):
    from siltstone.operators import drift

    old = spark.range(3000).selectExpr("id", "id * 2 AS a", "id % 7 AS b", "cast(id AS string) AS c", "NULL AS d", "array(id) AS e", "id % 7 AS f")
    new = spark.range(3000).selectExpr(
        "id", "IF(id % 20 = 0, NULL, id * 2) AS a2", "id % 7 AS g", "id * 2 + 1 AS other", "cast(id AS string) AS c2", "NULL AS d2", "array(id) AS e2"
    )
    values = drift.column_values(old)
    got = drift.renamed(values, drift.column_values(new)).collect()
    # One of the two equal columns finds a partner; columns without values and nested ones find none.
    assert [(r.old_name, r.new_name) for r in got] == [("b", "g"), ("c", "c2"), ("a", "a2")]
    assert [round(r.resemblance, 2) for r in got] == [1.0, 1.0, 0.95]
    assert drift.renamed(values, values).count() == 0
    assert drift.column_values(spark.range(1).selectExpr("array(id) AS x")).count() == 0
