import json

import pytest
from conftest import rows

from siltstone.operators import catalog as C
from siltstone.operators import profile as P
from siltstone.plans import model as M
from siltstone.plans import relate as R
from siltstone.session import small_frame
from siltstone.functions.types import family_of_name
from pyspark.sql import functions as F


def catalog(spark, columns):
    """Catalog rows from (schema, table, column, type)."""
    seen: dict = {}
    out = []
    for schema, name, column, dtype in columns:
        i = seen[schema, name] = seen.get((schema, name), 0) + 1
        model = name if schema == "main" else f"{schema}.{name}"
        out.append((schema, name, model, column, i, dtype, "", 0))
    df = small_frame(spark, out, C.CATALOG)
    return df.withColumn("family", family_of_name(F.col("data_type")))


def test_describe_reads_schemas_only(spark):
    df = spark.createDataFrame([], "id int, email string, tags array<string>")
    got = C.describe(spark, {"customers": df, "conn_1.orders": df.select("id")}).orderBy("model", "ordinal_position")
    assert [(r.table_schema, r.table_name, r.column_name, r.data_type, r.column_count) for r in got.collect()] == [
        ("conn_1", "orders", "id", "INTEGER", 1),
        ("main", "customers", "id", "INTEGER", 3),
        ("main", "customers", "email", "VARCHAR", 3),
        ("main", "customers", "tags", "VARCHAR[]", 3),
    ]


def test_ddl_lists_structure(spark):
    cat = catalog(spark, [("main", "customers", "id", "INTEGER"), ("main", "customers", "email", "VARCHAR")])
    assert C.ddl(cat).first().ddl == "CREATE TABLE customers (\n    id INTEGER,\n    email VARCHAR\n);"


def test_discovery_filters(spark):
    cat = catalog(
        spark,
        [
            ("main", "customers", "id", "INTEGER"),
            ("main", "customers", "id", "INTEGER"),
            ("main", "_dlt_loads", "id", "INTEGER"),
            ("main", "orders_staging", "id", "INTEGER"),
            ("main", "otps", "id", "INTEGER"),
            ("main", "sync_runs", "id", "INTEGER"),
            ("conn_a_staging", "t", "id", "INTEGER"),
            ("other", "t", "id", "INTEGER"),
            ("conn_app", "dashboards", "id", "INTEGER"),
            ("conn_app", "OTPS", "id", "INTEGER"),
            ("conn_app", "people", "id", "INTEGER"),
            ("conn_b", "dashboards", "id", "INTEGER"),
            ("conn_b", "people", "id", "INTEGER"),
        ],
    )
    assert rows(C.discover(cat).select("model", "column_name")) == [("conn_b.people", "id"), ("customers", "id")]
    assert rows(C.discover(cat, ["other", "bad name"]).select("model")) == [("other.t",)]
    assert rows(C.sources(C.discover(cat)).select("table_schema", "table_count", "is_main")) == [
        ("conn_b", 1, False),
        ("main", 1, True),
    ]


@pytest.mark.parametrize("exact", [False, True])
def test_profile(spark, exact):
    df = spark.createDataFrame(
        [(1, "a", [1]), (2, "b", [1]), (3, None, None), (4, "b", [2])], "id int, s string, l array<int>"
    )
    got = {r.column_name: r for r in P.summarize(df, "t", exact).collect()}
    assert (got["id"].cardinality, got["id"].min, got["id"].max, got["id"].null_percentage) == (4, "1", "4", 0.0)
    assert (got["s"].cardinality, got["s"].null_percentage, got["s"].row_count) == (2, 25.0, 4)
    assert (got["l"].cardinality, got["l"].min) == (2, None)
    assert rows(P.unique_columns(P.summarize(df, "t", exact)).select("column_name")) == [("id",)]


def test_profile_of_an_empty_table_and_of_many_columns(spark):
    empty = spark.createDataFrame([], "a int")
    r = P.summarize(empty, "t").first()
    assert (r.row_count, r.cardinality, r.null_percentage) == (0, 0, 0.0)
    assert P.unique_columns(P.summarize(empty, "t")).count() == 0
    wide = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(205)])
    got = P.summarize(wide, "w").orderBy("ordinal_position").collect()
    assert [r.ordinal_position for r in got] == list(range(1, 206))
    assert got[204].max == str(2 + 204)


def test_odd_names_are_quoted(spark):
    df = spark.createDataFrame([(1, 2)], ["a`b", "c'd"])
    got = {r.column_name: r.max for r in P.summarize(df, "it's", True).collect()}
    assert got == {"a`b": "1", "c'd": "2"}


def test_verify_unique_corrects_the_sketch(spark):
    ids = spark.range(20_000).select(
        "id", (F.col("id") % 19_000).alias("nearly"), F.concat(F.lit("n"), "id").alias("name")
    )
    profile = P.summarize(ids, "t")
    got = rows(P.verify_unique({"t": ids}, profile))
    assert got == [("t", "id", 20_000, 20_000), ("t", "name", 20_000, 20_000), ("t", "nearly", 20_000, 19_000)]
    exact = P.with_cardinality(profile, P.verify_unique({"t": ids}, profile))
    assert {r.column_name for r in P.mark_unique(exact).filter("is_unique").collect()} == {"id", "name"}


CLASSES = [
    ("_dlt_id", "VARCHAR", "METADATA", None, None),
    ("id", "BIGINT", "IDENTIFIER", None, None),
    ("user_id", "BIGINT", "FOREIGN_KEY", None, None),
    ("region_key", "BIGINT", "FOREIGN_KEY", None, None),
    ("due", "DATE", "TEMPORAL", None, None),
    ("created_at", "VARCHAR", "TEMPORAL", None, None),
    ("is_active", "INTEGER", "BOOLEAN", None, None),
    ("flag", "BOOLEAN", "BOOLEAN", None, None),
    ("description", "VARCHAR", "TEXT_LONG", None, None),
    ("payload", "JSON", "TEXT_LONG", None, None),
    ("price", "DECIMAL(12,2)", "MEASURE", "sum", "currency"),
    ("discount", "DOUBLE", "MEASURE", "sum", "number"),
    ("weight", "DOUBLE", "MEASURE", "sum", "number"),
    ("amount", "BIGINT", "MEASURE", "sum", "currency"),
    ("level", "INTEGER", "DIMENSION", None, None),
    ("amount_text", "VARCHAR", "DIMENSION", None, None),
    ("city", "VARCHAR", "DIMENSION", None, None),
]


def test_classification_rules(spark):
    cat = catalog(spark, [("main", "things", n, t) for n, t, *_ in CLASSES])
    got = M.classify(R.primary_keys(cat)).orderBy("ordinal_position")
    assert [(r.column_name, r.data_type, r.category, r.aggregation, r["format"]) for r in got.collect()] == CLASSES
    assert [r.column_name for r in got.filter("hidden").collect()] == ["_dlt_id"]
    roles = M.roles(got).first()
    assert roles.measures == ["price", "discount", "weight", "amount"]
    assert roles.temporal_columns == ["due", "created_at"]


def computed(spark, data, ddl):
    return M.computed_columns({"t": spark.createDataFrame(data, ddl)}).collect()


def test_computed_columns(spark):
    ddl = "id int, revenue double, cost double, profit double"
    exact = [(i, 10.0 * i, 4.0 * i, 6.0 * i) for i in range(1, 6)]
    (r,) = computed(spark, exact, ddl)
    assert (r.formula, r.validation, r.confidence, r.rows) == ("revenue - cost", "exact", 0.85, 5)
    near = [(i, 10.0 * i, 4.0 * i, 6.1 * i) for i in range(1, 6)]
    (r,) = computed(spark, near, ddl)
    assert (r.validation, r.confidence, r.approximate_rows) == ("approximate", 0.70, 5)
    assert computed(spark, [(i, 10.0 * i, 4.0, 99.0) for i in range(1, 6)], ddl) == []
    assert computed(spark, exact[:2], ddl) == []
    holes = [(1, None, 1.0, 1.0), (2, 1.0, 1.0, 0.0), *exact[:2]]
    (r,) = computed(spark, holes, ddl)
    assert (r.rows, r.exact_rows) == (3, 3)
    assert computed(spark, [(1, 0.5, 0.2, 0.0)] * 5, ddl) == []


def test_hints_take_the_first_column_in_order(spark):
    df = spark.createDataFrame([], "total_b double, subtotal double, price double, tax double, shipping double, x_id int")
    assert M.hinted_formulas(df) == [M.Formula("total_b", "subtotal", "tax", "+")]
    assert M.hinted_formulas(df.select("total_b", "price")) == []


def test_generate_whole_model(spark):
    customers = spark.createDataFrame([(i, f"n{i}") for i in range(1, 11)], "id int, name string")
    orders = spark.createDataFrame([(i, i % 10 + 1, 10.0 * i) for i in range(1, 41)], "id int, customer_id int, amount double")
    notes = spark.createDataFrame([("x",)], "body string")
    tables = {"conn_a.customers": customers, "conn_a.orders": orders, "conn_b.notes": notes}
    model = M.generate(spark, tables)
    (rel,) = model.relationships.collect()
    assert (rel["from"], rel.from_column, rel["to"], rel.to_column) == ("conn_a.customers", "id", "conn_a.orders", "customer_id")
    assert (rel.confidence, rel.method, rel.level) == (0.95, "statistical", "high")
    assert rel.condition == "`conn_a`.`customers`.`id` = `conn_a`.`orders`.`customer_id`"
    assert rows(model.isolated_tables.select("model")) == [("conn_b.notes",)]
    assert rows(model.isolated_sources) == [("conn_b",)]
    doc = json.loads(M.document(model))
    assert doc["version"] == "3.0" and [m["name"] for m in doc["models"]] == list(tables)
    assert doc["models"][1]["measures"] == ["amount"]
    assert doc["models"][0]["columns"][0]["stats"]["cardinality"] == 10
    assert doc["models"][0]["columns"][1]["is_unique"] is True
    assert len(doc["relationship_suggestions"]["high_confidence"]) == 1
    with pytest.raises(ValueError):
        M.generate(spark, {"elsewhere.t": notes})


def test_declared_keys_and_overrides_reach_the_model(spark):
    customers = spark.createDataFrame([(1, "a")], "id int, name string")
    orders = spark.createDataFrame([(1, 7)], "id int, buyer int")
    fks = spark.createDataFrame([("main.orders", "buyer", "main.customers", "id")], "fk_table string, fk_column string, pk_table string, pk_column string")
    over = spark.createDataFrame([("mine", "customers", "name", "orders", "buyer", 1.0)], "name string, `from` string, from_column string, `to` string, to_column string, confidence double")
    model = M.generate(spark, {"customers": customers, "orders": orders}, foreign_keys=fks, overrides=over)
    assert rows(model.relationships.select("name", "method")) == [
        ("mine", None),
        ("orders_buyer__customers_id_fk", "constraint"),
    ]


def test_prefixed_keys_without_a_profile(spark):
    users = spark.range(1, 21).select(F.col("id").alias("u_userkey"))
    visits = spark.range(1, 61).select(F.col("id").alias("v_visitkey"), (F.col("id") % 20 + 1).alias("v_userkey"))
    model = M.generate(spark, {"users": users, "visits": visits}, R.PREFIXED_KEYS)
    assert rows(model.relationships.select("from", "from_column", "to", "to_column")) == [
        ("users", "u_userkey", "visits", "v_userkey")
    ]
    assert {r.column_name: r.category for r in model.columns.collect()} == {
        "u_userkey": "IDENTIFIER", "v_visitkey": "IDENTIFIER", "v_userkey": "FOREIGN_KEY",
    }
