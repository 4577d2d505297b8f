"""Previews, histories and SQL over the given tables."""

from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.values import plain_results, safe_ratio
from siltstone.operators import fences
from siltstone.operators import history as H
from siltstone.operators import preview
from siltstone.operators import sync as S
from siltstone.operators.layers import Lake
from siltstone.plans import sql as Q
from siltstone.session import small_frame, work_dir
from siltstone.suite.registry import query
from siltstone.suite.tables import table


@query("""
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(concat_ws(' | ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'brand#1')
   OR contains(lower(p_name), 'ring')
""")
def search_rows(spark, root):
    """Two searches over all columns, whatever the case."""
    part = table(spark, root, "part")
    both = preview.search(part, "BRAND#1").union(preview.search(part, "Ring")).distinct()
    return both.select("p_partkey", "p_name", "p_brand")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(source), 'the ') OR contains(lang, 'the ')")
def search_documents(spark, root):
    """A search through whole texts."""
    return preview.search(table(spark, root, "documents"), "The ").select("doc_id", "lang")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 200")
def page_rows(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return preview.page(orders, ["o_totalprice", "o_orderkey"], 50, 200)


@query("""
WITH f AS (SELECT o_totalprice AS p, o_orderkey AS k FROM orders ORDER BY 1, 2 LIMIT 1 OFFSET 199)
SELECT o_orderkey, o_totalprice FROM orders, f WHERE (o_totalprice, o_orderkey) > (p, k)
ORDER BY o_totalprice, o_orderkey LIMIT 50
""")
def page_after(spark, root):
    """The same page by the values of the row before it."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    order = ["o_totalprice", "o_orderkey"]
    before = preview.page(orders, order, 1, 199).first()
    return preview.page(orders, order, 50, after=(before.o_totalprice, before.o_orderkey))


@query("SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1000")
def preview_sorted(spark, root):
    return preview.table(table(spark, root, "customer"), ["c_acctbal", "c_custkey"], descending=True)


@query("""
SELECT conv_id, turn, role, text FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn <= 3
""")
def last_messages(spark, root):
    """The last three messages of every conversation; most have more."""
    return H.last_n(table(spark, root, "conversations"), "conv_id", ["turn", "role", "text"], 3)


@query("""
SELECT user_id, event_id, event_type FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3
""")
def last_events(spark, root):
    """The last three events of every user."""
    return H.last_n(table(spark, root, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "event_type")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1
""")
def latest_orders(spark, root):
    newest = H.latest(table(spark, root, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


NATION_SQL = """
WITH spend AS (
  SELECT c_nationkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM shop__orders JOIN crm__customer ON o_custkey = c_custkey
  WHERE o_orderstatus <> 'F' GROUP BY c_nationkey)
SELECT n_name, CAST(total AS DOUBLE) AS total, RANK() OVER (ORDER BY total DESC) AS place
FROM spend JOIN crm__nation ON c_nationkey = n_nationkey
"""


@query(NATION_SQL.replace("shop__", "").replace("crm__", ""))
def sql_across_sources(spark, root):
    """A statement with a CTE, joins and a window over tables of two sources."""
    tables = {
        "shop.orders": table(spark, root, "orders"),
        "crm.customer": table(spark, root, "customer"),
        "crm.nation": table(spark, root, "nation"),
    }
    return Q.limited(Q.run(spark, NATION_SQL, tables))


@query("""
SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 9000
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'
""")
def sql_set_operations(spark, root):
    text = """
    SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 9000
    EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'
    """
    return Q.run(spark, text, {n: table(spark, root, n) for n in ("orders", "customer")})


@query("""
SELECT COUNT(*) AS shown, MIN(o_orderkey) AS first, (SELECT COUNT(*) FROM orders) AS unlimited
FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7000)
""")
def limited_result(spark, root):
    """A limit is honoured as it is given, and without one nothing is cut."""
    rows = table(spark, root, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey"))
    return Q.limited(rows, 7000).agg(F.count(F.lit(1)).alias("shown"), F.min("o_orderkey").alias("first")).withColumn(
        "unlimited", Q.limited(rows).agg(F.count(F.lit(1))).scalar()
    )


@query("""
SELECT 'SELECT o_orderstatus, COUNT(*) AS n FROM log_orders GROUP BY 1' AS sql, COUNT(DISTINCT o_orderstatus) AS rows, 'success' AS status FROM orders
UNION ALL SELECT 'SELECT no_such_column FROM log_orders', 0, 'failed'
""")
def query_history(spark, root):
    """Two logged statements, one of which fails."""
    path = work_dir(spark, "queries")
    Q.register({"log_orders": table(spark, root, "orders")})
    for i, text in enumerate(
        ["SELECT o_orderstatus, COUNT(*) AS n FROM log_orders GROUP BY 1", "SELECT no_such_column FROM log_orders"]
    ):
        try:
            Q.run_logged(spark, "shop", text, f"{path}/log", f"{path}/result{i}")
        except Exception:  # the failure is what the log shows
            pass
    return H.queries(spark.read.parquet(f"{path}/log"), "shop").select("sql", "rows", "status")


@query("""
SELECT 'nation' AS table, 'success' AS status, COUNT(*) AS rows_synced FROM nation
UNION ALL SELECT 'region', 'success', COUNT(*) FROM region
""")
def sync_history(spark, root):
    lake = Lake(work_dir(spark, "syncs"))
    S.run(lake, "geo", {n: table(spark, root, n) for n in ("nation", "region")})
    log = spark.read.parquet(f"{lake.base}/_syncs")
    return H.syncs(log, "geo").select("table", "status", "rows_synced")


@query("""
WITH s AS (SELECT source, COUNT(*) AS docs, COUNT(*) FILTER (WHERE lang = 'en') AS english FROM documents GROUP BY 1)
SELECT source, CASE WHEN source = 'src0' THEN 'running' WHEN english = 0 THEN 'never' ELSE 'success' END AS status,
       CASE WHEN source != 'src0' AND english = 0 THEN 0 ELSE docs END AS rows_cached FROM s
""")
def sync_status(spark, root):
    """Status per document source: stored tables are its English documents, one source is running."""
    docs = table(spark, root, "documents")
    configs = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows_cached")).select(
        "source", F.lit("success").alias("status"), F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)).alias("last_sync_at"),
        "rows_cached", F.lit(None).cast("string").alias("error"),
    )
    stored = docs.filter("lang = 'en'").groupBy("source").agg(F.collect_set("lang").alias("tables"))
    running = small_frame(spark, [("src0",)], "source string")
    return H.sync_status(configs, stored, running).select("source", "status", "rows_cached")


@query("""
SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders
""")
def plain_rows(spark, root):
    """Decimals as double and times as ISO text, as a client gets them."""
    return plain_results(
        table(spark, root, "orders").select(
            "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderdate").alias("at")
        )
    )


@query("""
SELECT l_returnflag, l_linestatus, COALESCE(SUM(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE
  / NULLIF(COUNT(*) FILTER (WHERE l_discount > 0.09), 0), 0) AS ratio FROM lineitem GROUP BY 1, 2
""")
def safe_ratios(spark, root):
    """A ratio whose denominator may be 0."""
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    some = F.count(F.when(F.col("l_discount") > 0.09, 1))
    return table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(safe_ratio(total, some).alias("ratio"))


@query("""
WITH s AS (SELECT user_id, MAX(ts) AS last FROM events GROUP BY 1), n AS (SELECT MAX(ts) AS now FROM events)
SELECT user_id, last + INTERVAL 120 MINUTE <= now AS due FROM s, n
""")
def due_syncs(spark, root):
    """Users whose last event is at least two hours older than the newest, by the sync rule."""
    events = table(spark, root, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = events.agg(F.max("ts")).scalar()
    return last.select("user_id", S.is_due(F.col("last"), F.lit(120), now).alias("due"))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, rn - 1 AS position FROM
 (SELECT *, ROW_NUMBER() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rn FROM lineitem)
WHERE rn > (SELECT COUNT(*) // 4 * 3 FROM lineitem) AND rn <= (SELECT COUNT(*) // 4 * 3 + 100 FROM lineitem)
""")
def deep_page(spark, root):
    """A hundred order lines behind three quarters of all by their price, with the position that the index gives the first of them."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    folder = work_dir(spark, "fences")
    fences.write(lines, folder, order, range_rows=5000)
    offset = fences.fences(spark, folder).agg(F.sum("rows")).first()[0] // 4 * 3
    found = fences.page(spark, folder, order, 100, offset)
    first = found.first()
    at = fences.position(spark, folder, order, tuple(first[c] for c in order)).first().position
    # The page is at most a hundred rows.
    place = F.row_number().over(Window.orderBy(*order)) - 1 + F.lit(at)
    return found.withColumn("position", place.cast("long"))
