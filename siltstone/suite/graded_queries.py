"""Rules over metadata, with the metadata taken from the given tables' rows, and small reading functions."""

import json

from pyspark.sql import functions as F

from siltstone.functions import names as N
from siltstone.functions.types import sql_name
from siltstone.functions.values import format_value
from siltstone.operators import layers as L
from siltstone.operators.layers import Lake
from siltstone.plans import metrics as MQ
from siltstone.plans import model as M
from siltstone.plans import relate as R
from siltstone.session import small_frame, work_dir
from siltstone.sources import files
from siltstone.sources import tables as TB
from siltstone.suite.model_queries import _tables
from siltstone.suite.registry import query
from siltstone.suite.tables import table


@query("""
SELECT 'main.' || r_name AS "from", 'id' AS from_column, 'main.' || n_name AS "to", 'r_id' AS to_column, 1.0::DOUBLE AS confidence, 'constraint' AS method
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 != 0 AND r_regionkey != 2
""")
def declared_relationships(spark, root):
    """Foreign keys of an information schema with a table per nation and region; every fourth constraint is no foreign key, one table is unknown."""
    nation, region = table(spark, root, "nation"), table(spark, root, "region")
    schema, name = F.lit("main").alias("table_schema"), F.concat(F.lit("fk_"), F.col("n_nationkey")).alias("constraint_name")
    kind = F.when(F.col("n_nationkey") % 4 != 0, "FOREIGN KEY").otherwise("CHECK").alias("constraint_type")
    used = nation.select(name, schema, F.col("n_name").alias("table_name"), F.lit("r_id").alias("column_name"))
    target = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        name, schema, F.col("r_name").alias("table_name"), F.lit("id").alias("column_name")
    )
    declared = R.source_constraints(nation.select(name, schema, kind), used, target).withColumns(
        {c: F.concat(F.lit("main."), F.col(c)) for c in ("fk_table", "pk_table")}
    )
    known = nation.select(F.col("n_name").alias("table_name"), F.lit("r_id").alias("column_name")).union(
        region.filter("r_regionkey != 2").select("r_name", F.lit("id"))
    )
    catalog = known.select(
        F.concat(F.lit("main."), "table_name").alias("model"), schema, "table_name", "column_name",
        F.lit("BIGINT").alias("data_type"), F.lit("integer").alias("family"),
    )
    return R.by_constraint(catalog, declared).select("from", "from_column", "to", "to_column", "confidence", "method")


@query("""
WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status, 0.5 AS old
           FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT c_custkey AS k, ROUND(0.3 + c_nationkey / 100, 2) AS new FROM customer WHERE c_custkey % 5 != 0 AND c_custkey % 7 != 0)
SELECT 't' || COALESCE(s.k, f.k) AS from_table, COALESCE(status, 'pending') AS status,
       CASE WHEN status IS NULL OR status = 'pending' AND f.k IS NOT NULL THEN new ELSE old END::DOUBLE AS confidence
FROM s FULL JOIN f ON s.k = f.k
""")
def stored_suggestions(spark, root):
    """Suggestions per customer after a new round: new and pending ones take its confidence, decided ones and those in the model do not."""
    customer = table(spark, root, "customer")
    name = F.concat(F.lit("t"), F.col("c_custkey"))
    ends = [name.alias("from_table"), F.lit("u_id").alias("from_column"), F.lit("users").alias("to_table"), F.lit("id").alias("to_column")]
    status = F.element_at(F.array(*map(F.lit, ("pending", "confirmed", "rejected"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    stored = customer.filter("c_custkey % 2 = 0").select(*ends, F.lit(0.5).alias("confidence"), status.alias("status"))
    fresh = customer.filter("c_custkey % 5 != 0").select(*ends, F.round(0.3 + F.col("c_nationkey") / 100, 2).alias("confidence"))
    # Held by the model the other way round.
    model = customer.filter("c_custkey % 7 = 0").select(
        name.alias("from"), F.lit("u_id").alias("from_column"), F.lit("users").alias("to"), F.lit("id").alias("to_column")
    )
    return R.upsert_suggestions(stored, fresh, model).select("from_table", "status", "confidence")


@query("""
SELECT 'r' || s_suppkey AS name, 1.0::DOUBLE AS confidence FROM supplier
UNION ALL SELECT 'r' || c_custkey, 0.5 FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c_custkey % 10 != 0
""")
def overridden_relationships(spark, root):
    """User-defined relationships are added under new names only; those without a name and repeated ones are not."""
    supplier, customer = table(spark, root, "supplier"), table(spark, root, "customer")
    model = supplier.select(F.concat(F.lit("r"), "s_suppkey").alias("name"), F.lit(1.0).alias("confidence"))
    named = F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("r"), "c_custkey"))
    own = customer.select(named.alias("name"), F.lit(0.5).alias("confidence"))
    return R.apply_overrides(model, own.union(own.filter("c_custkey < 50")))


@query("""
SELECT 'changed' AS source, 'updated_at' AS cursor, strftime(MAX(o_orderdate), '%Y-%m-%d') AS newest FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'made', 'created_at', strftime(MAX(ts), '%Y-%m-%d') FROM events
UNION ALL SELECT 'plain', NULL, NULL
""")
def picked_cursors(spark, root):
    """The change-time column of three sources, the first of the usual names, and its newest value."""
    orders, events = table(spark, root, "orders"), table(spark, root, "events")
    sources = {
        "changed": orders.filter("o_orderstatus = 'F'").select(F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at")),
        "made": events.select(F.col("ts").alias("created_at"), "value"),
        "plain": events.select("ts"),
    }
    found = []
    for name, df in sources.items():
        cursor = TB.pick_cursor(df)
        newest = TB.high_water_mark(df, cursor).select(F.date_format("high_water_mark", "yyyy-MM-dd")).first()[0] if cursor else None
        found.append((name, cursor, newest))
    return small_frame(spark, found, "source string, cursor string, newest string")


@query("SELECT 7::BIGINT AS rows, COUNT(*) >= 7 AS enough, TRUE AS stored FROM orders")
def first_rows(spark, root):
    """A raw table's first seven rows in two columns; which they are is open, but they are rows of the table."""
    lake = Lake(work_dir(spark, "first"))
    orders = table(spark, root, "orders")
    L.write_bronze(lake, "shop", "orders", orders)
    some = L.read_bronze(spark, lake, "shop", "orders", ["o_orderkey", "o_totalprice"], 7)
    known = some.join(orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")), F.expr("k = o_orderkey AND p = o_totalprice"), "left")
    return known.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(orders.limit(7).count() == 7).alias("enough"), F.every(F.col("k").isNotNull()).alias("stored")
    )


@query("""
SELECT table_name || '.parquet' AS file, column_name, data_type FROM information_schema.columns WHERE table_name IN ('customer', 'part', 'events')
UNION ALL
SELECT 'nation.csv', column_name, CASE data_type WHEN 'BIGINT' THEN 'INTEGER' ELSE data_type END FROM information_schema.columns WHERE table_name = 'nation'
""")
def file_schemas(spark, root):
    """Columns and types of files: Parquet by its footer, CSV by its rows."""
    at = f"{work_dir(spark, 'csv')}/nation.csv"
    table(spark, root, "nation").coalesce(1).write.option("header", True).csv(at)
    paths = {f"{n}.parquet": f"{root}/{n}.parquet" for n in ("customer", "part", "events")} | {"nation.csv": at}
    found = [(n, f.name, sql_name(f.dataType)) for n, p in paths.items() for f in files.schema_of(spark, p).fields]
    return small_frame(spark, found, "file string, column_name string, data_type string")


@query("SELECT o_orderkey, o_totalprice AS price, o_totalprice * 2 AS twice, 'o_orderkey' AS index_column, 'price, twice' AS categories FROM orders")
def plain_metric_rows(spark, root):
    """Metrics without aggregation are the rows themselves; the first column is the widget's index, the others its categories."""
    metrics = [MQ.Metric("price", "none", "o_totalprice"), MQ.Metric("twice", "none", "o_totalprice * 2")]
    out = MQ.query(table(spark, root, "orders"), metrics, "o_orderkey")
    index, categories = MQ.shape(out)
    return out.withColumns({"index_column": F.lit(index), "categories": F.lit(", ".join(categories))})


@query("""
SELECT * FROM (SELECT p_brand, COUNT(*) AS parts FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
UNION ALL SELECT NULL, COUNT(*) FROM part
""")
def limited_widget(spark, root):
    """A widget with its own limit beside one without, as planned."""
    plan = MQ.DashboardPlan(
        "parts", [MQ.Metric("parts", "count")],
        [MQ.Visualization("bar", ["parts"], "p_brand", "top", limit=3), MQ.Visualization("number", ["parts"], title="all", limit=3)],
    )
    w = MQ.dashboard(table(spark, root, "part"), plan)
    return w["top"].unionByName(w["all"].withColumn("p_brand", F.lit(None).cast("string")))


def _compact_sql(v, unit, suffix):
    tenths = f"CAST(round({v} / {unit} / 0.1) AS BIGINT)"
    short = f"CAST({tenths} // 10 AS VARCHAR) || CASE WHEN {tenths} % 10 = 0 THEN '' ELSE '.' || ({tenths} % 10) END"
    return f"CASE WHEN {v} / {unit} < 9.95 THEN {short} ELSE CAST(CAST(round({v} / {unit}) AS BIGINT) AS VARCHAR) END || '{suffix}'"


@query(
    "SELECT o_orderkey, CASE WHEN v >= 999500000 THEN " + _compact_sql("v", "1e9", "B") + " WHEN v >= 999500 THEN " + _compact_sql("v", "1e6", "M")
    + " WHEN v >= 999.5 THEN " + _compact_sql("v", "1e3", "K") + " ELSE " + _compact_sql("v", "1", "")
    + " END AS compact FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice) / 100 + 1 "
    + "WHEN 2 THEN floor(o_totalprice) * 17 ELSE floor(o_totalprice) * 10007 END AS v FROM orders)"
)
def compact_values(spark, root):
    """Short display texts of numbers from ones to billions."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey") % 4
    whole = F.floor(price).cast("double")
    v = F.when(key == 0, price).when(key == 1, whole / 100 + 1).when(key == 2, whole * 17).otherwise(whole * 10007)
    return table(spark, root, "orders").select("o_orderkey", format_value(v, "compact").alias("compact"))


@query("""
WITH RECURSIVE p AS (
  SELECT DISTINCT a, b FROM (SELECT lower(n_name) AS a FROM nation), (SELECT DISTINCT lower(c_mktsegment) AS b FROM customer)),
lcs AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) AS prev FROM p
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: greatest(prev[j], coalesce(list_max(
    list_transform(list_filter(range(2, j + 1), lambda k: b[k - 1] = a[i + 1]), lambda k: prev[k - 1] + 1)), 0)))
  FROM lcs WHERE i < length(a))
SELECT a, b, round(200.0 * prev[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM lcs WHERE i = length(a)
""")
def name_ratios(spark, root):
    """How alike the names of nations and market segments are, by their longest common subsequence."""
    names = table(spark, root, "nation").select(F.lower("n_name").alias("a"), F.lit(1).alias("one"))
    others = table(spark, root, "customer").select(F.lower("c_mktsegment").alias("b"), F.lit(1).alias("one")).distinct()
    pairs = names.join(others, "one").select("a", "b")
    return pairs.select("a", "b", F.round(N.indel_similarity("a", "b"), 6).alias("ratio"))


@query("""
SELECT table_name AS model, column_name, data_type AS type,
       column_name IN ('o_orderkey', 'c_custkey', 'n_nationkey') AS primary_key,
       CASE table_name WHEN 'orders' THEN (SELECT COUNT(DISTINCT o_custkey) FROM orders) WHEN 'customer' THEN (SELECT COUNT(DISTINCT c_nationkey) FROM customer) END AS references_found,
       (SELECT COUNT(*) FROM (SELECT 1 FROM orders LIMIT 1)) + 1 AS relationships
FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'nation')
""")
def model_document(spark, root):
    """The model of three tables as its JSON document, taken apart again: columns with their keys, and the values of each table's reference that the document's relationships count."""
    tables = _tables(spark, root, ["orders", "customer", "nation"])
    doc = json.loads(M.document(M.generate(spark, tables, R.PREFIXED_KEYS)))
    counts = {r["to"]: r["total_count"] for r in doc["relationships"] if r["method"] == "statistical"}
    found = [
        (m["table_name"], c["name"], c["type"], c["primary_key"], counts.get(m["table_name"]), len(doc["relationships"]))
        for m in doc["models"]
        for c in m["columns"]
    ]
    return small_frame(
        spark, found, "model string, column_name string, type string, primary_key boolean, references_found bigint, relationships bigint"
    )
