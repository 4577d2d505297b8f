"""Sales dashboard results over orders and customer."""

from pyspark.sql import functions as F

from siltstone.plans import dashboards as d
from siltstone.plans.dashboards import OrderColumns
from siltstone.session import work_dir
from siltstone.suite.registry import query
from siltstone.suite.tables import table

ORDERS = OrderColumns(
    order_id="o_orderkey",
    customer="o_custkey",
    amount="o_totalprice",
    date="o_orderdate",
    status="o_orderstatus",
    payment="o_orderpriority",
    customer_id="c_custkey",
    customer_name="c_name",
    region="c_mktsegment",
    cancelled="F",
)


@query("""
SELECT c.c_name AS customer, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       COUNT(o.o_orderkey) AS orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus != 'F'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def top_customers(spark, root):
    return d.top_customers(table(spark, root, "orders"), table(spark, root, "customer"), ORDERS)


@query("""
SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus != 'F') AS DOUBLE) AS total_revenue,
       ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus != 'F') AS DOUBLE)
             / COUNT(o_totalprice) FILTER (WHERE o_orderstatus != 'F'), 2) AS avg_order_value,
       COUNT(*) AS total_orders,
       (SELECT COUNT(*) FROM customer) AS total_customers
FROM orders
""")
def kpis(spark, root):
    return d.kpis(table(spark, root, "orders"), table(spark, root, "customer"), ORDERS)


@query("""
SELECT strftime(date_trunc('month', o_orderdate), '%b %Y') AS month,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders WHERE o_orderstatus != 'F'
GROUP BY date_trunc('month', o_orderdate) ORDER BY date_trunc('month', o_orderdate)
""")
def revenue_by_month(spark, root):
    return d.trend(table(spark, root, "orders"), ORDERS)


@query("SELECT o_orderstatus, COUNT(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def orders_by_status(spark, root):
    return d.count_by(table(spark, root, "orders"), "o_orderstatus")


@query("""
SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders WHERE o_orderstatus != 'F' GROUP BY 1 ORDER BY 2 DESC, 1
""")
def revenue_by_priority(spark, root):
    return d.revenue_by(table(spark, root, "orders"), "o_orderpriority", ORDERS)


@query("""
SELECT n_name, CAST(COUNT(*) AS BIGINT) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def customers_by_nation(spark, root):
    return d.by_region(
        table(spark, root, "customer"), "c_nationkey", table(spark, root, "nation"), "n_nationkey", "n_name"
    )


@query("SELECT c_mktsegment, COUNT(*) AS customers FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def customers_by_segment(spark, root):
    return d.count_by(table(spark, root, "customer"), "c_mktsegment", "customers", 10)


@query("""
SELECT o.o_orderkey, c.c_name AS customer, strftime(o.o_orderdate, '%Y-%m-%d') AS date,
       o.o_orderstatus AS status, CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       o.o_orderpriority AS payment_method
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 15
""")
def recent_orders(spark, root):
    return d.recent(table(spark, root, "orders"), table(spark, root, "customer"), ORDERS)


@query("""
WITH kept AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE o_orderstatus != 'F'),
k AS (SELECT CAST(SUM(v) AS DOUBLE) AS v, ROUND(CAST(SUM(v) AS DOUBLE) / COUNT(v), 2) AS a FROM kept)
SELECT 'kpis' AS widget, 'total_revenue' AS label, v AS value FROM k
UNION ALL SELECT 'kpis', 'avg_order_value', a FROM k
UNION ALL SELECT 'kpis', 'total_orders', CAST(COUNT(*) AS DOUBLE) FROM orders
UNION ALL SELECT 'kpis', 'total_customers', CAST(COUNT(*) AS DOUBLE) FROM customer
UNION ALL
SELECT 'revenue_trend', strftime(date_trunc('month', o_orderdate), '%b %Y'), CAST(SUM(v) AS DOUBLE) FROM kept
GROUP BY date_trunc('month', o_orderdate)
UNION ALL
SELECT * FROM (SELECT 'top_customers', c_name, CAST(SUM(v) AS DOUBLE) AS r FROM kept JOIN customer ON o_custkey = c_custkey
GROUP BY c_name ORDER BY r DESC, c_name LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'recent_orders', c_name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY o_orderdate DESC, o_orderkey LIMIT 15)
UNION ALL
SELECT 'orders_by_status', o_orderstatus, CAST(COUNT(*) AS DOUBLE) FROM orders GROUP BY 2
UNION ALL
SELECT 'revenue_by_payment', o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
FROM orders WHERE o_orderstatus != 'F' GROUP BY 2
UNION ALL
SELECT 'customers_by_region', c_mktsegment, CAST(COUNT(*) AS DOUBLE) FROM customer GROUP BY 2
""")
def command_center(spark, root):
    """All seven widgets of the dashboard brought into one (widget, label, value) result."""
    w = d.command_center(table(spark, root, "orders"), table(spark, root, "customer"), ORDERS, work_dir(spark, "dashboard"))
    kpis = w["kpis"].select([F.col(c).cast("double").alias(c) for c in w["kpis"].columns])
    parts = {
        "kpis": kpis.unpivot([], kpis.columns, "label", "value"),
        "top_customers": w["top_customers"].select("customer", "revenue"),
        "recent_orders": w["recent_orders"].select("customer", "amount"),
        **{n: w[n] for n in ("revenue_trend", "orders_by_status", "revenue_by_payment", "customers_by_region")},
    }
    tagged = [
        p.toDF("label", "value").select(F.lit(n).alias("widget"), "label", F.col("value").cast("double").alias("value"))
        for n, p in parts.items()
    ]
    result = tagged[0]
    for t in tagged[1:]:
        result = result.unionByName(t)
    return result
