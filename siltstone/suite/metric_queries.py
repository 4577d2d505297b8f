"""Metric queries over orders, lineitem and the tables they refer to."""

from pyspark.sql import functions as F

from siltstone.plans import metrics as m
from siltstone.plans.metrics import DashboardPlan, Edge, Metric, TimeRange, Visualization
from siltstone.suite.registry import query
from siltstone.suite.tables import table

CENTS = "CAST(o_totalprice AS DECIMAL(18,2))"

GRAPH = [
    Edge("customer", "c_custkey", "orders", "o_custkey"),
    Edge("orders", "o_orderkey", "lineitem", "l_orderkey"),
    Edge("part", "p_partkey", "lineitem", "l_partkey"),
    Edge("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    Edge("nation", "n_nationkey", "customer", "c_nationkey"),
    Edge("nation", "n_nationkey", "supplier", "s_nationkey"),
    Edge("region", "r_regionkey", "nation", "n_regionkey"),
]


@query("""
SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       COUNT(*) AS orders, MIN(o_totalprice) AS smallest, MAX(o_totalprice) AS largest,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS average
FROM orders WHERE o_orderstatus != 'F' GROUP BY 1
""")
def metric_by_priority(spark, root):
    """Sum, count, min, max and average by one dimension with a status filter."""
    out = m.query(
        table(spark, root, "orders"),
        [
            Metric("revenue", "sum", CENTS),
            Metric("orders", "count"),
            Metric("smallest", "min", "o_totalprice"),
            Metric("largest", "max", "o_totalprice"),
            Metric("priced", "count", "o_totalprice"),
        ],
        breakdown="o_orderpriority",
        filters=["o_orderstatus != 'F'"],
    )
    return out.selectExpr(
        "o_orderpriority", "CAST(revenue AS DOUBLE) AS revenue", "orders", "smallest", "largest",
        "CAST(revenue AS DOUBLE) / priced AS average",
    )


@query("""
SELECT o_orderpriority, o_orderstatus, COUNT(*) AS orders, median(o_totalprice) AS middle
FROM orders GROUP BY 1, 2
""")
def metric_median(spark, root):
    return m.query(
        table(spark, root, "orders"),
        [Metric("orders", "count"), Metric("middle", "median", "o_totalprice")],
        breakdown=["o_orderpriority", "o_orderstatus"],
    )


@query("""
SELECT event_type, median(CASE WHEN event_type NOT IN ('error', 'view') THEN value END) AS a,
       median(CASE WHEN event_type NOT IN ('click', 'view') THEN value END) AS b
FROM events GROUP BY 1
""")
def metric_median_nulls(spark, root):
    """Medians alone: groups without a value of one or of both stay, in whichever place the metric stands."""
    a = "CASE WHEN event_type NOT IN ('error', 'view') THEN value END"
    b = "CASE WHEN event_type NOT IN ('click', 'view') THEN value END"
    return m.query(table(spark, root, "events"), [Metric("a", "median", a), Metric("b", "median", b)], breakdown="event_type")


@query("""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, COUNT(*) AS orders FROM orders GROUP BY 1
""")
def dashboard_by_day(spark, root):
    """A line of all days of a plan; no limit is stated, so none applies."""
    days = table(spark, root, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    plan = DashboardPlan("Orders", [Metric("orders", "count")], [Visualization("line", ["orders"], "day", "By day")])
    return m.dashboard(days, plan)["By day"]


@query("SELECT median(l_extendedprice) AS middle, median(l_quantity) AS middle_quantity FROM lineitem")
def metric_median_total(spark, root):
    return m.query(
        table(spark, root, "lineitem"),
        [Metric("middle", "median", "l_extendedprice"), Metric("middle_quantity", "median", "l_quantity")],
    )


@query("""
SELECT o_orderpriority,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
       / CAST(SUM(SUM(CAST(o_totalprice AS DECIMAL(18,2)))) OVER () AS DOUBLE) * 100 AS share
FROM orders GROUP BY 1
""")
def metric_share(spark, root):
    return m.query(table(spark, root, "orders"), [Metric("share", "percentage", CENTS)], "o_orderpriority")


@query("""
SELECT event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1
""")
def metric_last_7d(spark, root):
    out = m.query(
        table(spark, root, "events"),
        [Metric("events", "count"), Metric("total", "sum", "CAST(value AS DECIMAL(18,2))")],
        breakdown="event_type",
        time=TimeRange("ts", "7d"),
    )
    return out.selectExpr("event_type", "events", "CAST(total AS DOUBLE) AS total")


@query("""
SELECT o_orderstatus, COUNT(*) AS orders FROM orders
WHERE o_orderdate >= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY 1
""")
def metric_last_30d(spark, root):
    return m.query(
        table(spark, root, "orders"), [Metric("orders", "count")], "o_orderstatus",
        time=TimeRange("o_orderdate", "Last 30 Days"),
    )


@query("""
SELECT o_orderstatus, COUNT(*) AS orders FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-06-15' GROUP BY 1
""")
def metric_year_to_date(spark, root):
    return m.query(
        table(spark, root, "orders"), [Metric("orders", "count")], "o_orderstatus",
        time=TimeRange("o_orderdate", "ytd", anchor="1998-06-15"),
    )


@query("""
SELECT COUNT(*) AS orders, MAX(o_totalprice) AS largest FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1996-05-31'
""")
def metric_custom_range(spark, root):
    return m.query(
        table(spark, root, "orders"), [Metric("orders", "count"), Metric("largest", "max", "o_totalprice")],
        time=TimeRange("o_orderdate", "custom", start="1996-03-01", end="1996-05-31"),
    )


@query("""
SELECT p_brand, CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS retail
FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def metric_top_brands(spark, root):
    out = m.query(
        table(spark, root, "part"), [Metric("retail", "sum", "CAST(p_retailprice AS DECIMAL(18,2))")], "p_brand",
        limit=10,
    )
    return out.selectExpr("p_brand", "CAST(retail AS DOUBLE) AS retail")


@query("""
SELECT r_name, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def metric_along_path(spark, root):
    """Orders by region name: three many-to-one steps found in the relationship graph."""
    names = ["orders", "customer", "nation", "region"]
    out = m.query_related(
        {n: table(spark, root, n) for n in names}, GRAPH,
        {"orders": [Metric("revenue", "sum", CENTS), Metric("orders", "count")]},
        ("region", "r_name"),
    )
    return out.selectExpr("r_name", "CAST(revenue AS DOUBLE) AS revenue", "orders")


@query("""
WITH a AS (
  SELECT n_name, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS customer_balance, COUNT(*) AS customers
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
b AS (
  SELECT n_name, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS shipped
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT COALESCE(a.n_name, b.n_name) AS n_name, customer_balance, customers, shipped
FROM a FULL JOIN b ON a.n_name = b.n_name
""")
def metric_two_facts(spark, root):
    """Two fact tables over a shared dimension without one multiplying the other."""
    names = ["customer", "lineitem", "supplier", "nation", "orders"]
    out = m.query_related(
        {n: table(spark, root, n) for n in names}, GRAPH,
        {
            "customer": [
                Metric("customer_balance", "sum", "CAST(c_acctbal AS DECIMAL(18,2))"),
                Metric("customers", "count"),
            ],
            "lineitem": [Metric("shipped", "sum", "CAST(l_quantity AS DECIMAL(18,2))")],
        },
        ("nation", "n_name"),
    )
    return out.selectExpr(
        "n_name", "CAST(customer_balance AS DOUBLE) AS customer_balance", "customers",
        "CAST(shipped AS DOUBLE) AS shipped",
    )


@query("""
WITH o AS (
  SELECT c_mktsegment, n_name, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
l AS (
  SELECT c_mktsegment, n_name, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, MAX(l_shipdate) AS shipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT COALESCE(o.c_mktsegment, l.c_mktsegment) AS c_mktsegment, COALESCE(o.n_name, l.n_name) AS n_name, revenue, orders, quantity,
       strftime(shipped, '%Y-%m-%d') AS shipped
FROM o FULL JOIN l ON o.c_mktsegment = l.c_mktsegment AND o.n_name = l.n_name
""")
def metric_two_breakdowns(spark, root):
    """Two facts by columns of two tables; the lines reach the nation by the customer, as that step is needed anyway."""
    names = ["orders", "lineitem", "customer", "supplier", "nation"]
    out = m.query_related(
        {n: table(spark, root, n) for n in names}, GRAPH,
        {
            "orders": [Metric("revenue", "sum", CENTS), Metric("orders", "count")],
            "lineitem": [Metric("quantity", "sum", "CAST(l_quantity AS DECIMAL(18,2))"), Metric("shipped", "max", "l_shipdate")],
        },
        [("customer", "c_mktsegment"), ("nation", "n_name")],
    )
    return out.selectExpr(
        "c_mktsegment", "n_name", "CAST(revenue AS DOUBLE) AS revenue", "orders", "CAST(quantity AS DOUBLE) AS quantity",
        "date_format(shipped, 'yyyy-MM-dd') AS shipped",
    )


@query("""
SELECT l_returnflag AS label, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       COUNT(*) AS lines
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1997-12-31' GROUP BY 1
UNION ALL
SELECT 'all', CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), COUNT(*)
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1997-12-31'
""")
def plan_dashboard(spark, root):
    """A two-widget plan (one number, one bar chart) over a fixed period."""
    plan = DashboardPlan(
        "Shipping",
        [Metric("revenue", "sum", "CAST(l_extendedprice AS DECIMAL(18,2))"), Metric("lines", "count")],
        [
            Visualization("number", ["revenue", "lines"], title="total"),
            Visualization("bar", ["revenue", "lines"], "l_returnflag", title="by flag"),
        ],
        TimeRange("l_shipdate", "custom", start="1997-01-01", end="1997-12-31"),
    )
    widgets = m.dashboard(table(spark, root, "lineitem"), plan)
    number = widgets["total"].selectExpr("'all' AS label", "CAST(revenue AS DOUBLE) AS revenue", "lines")
    bars = widgets["by flag"].selectExpr("l_returnflag AS label", "CAST(revenue AS DOUBLE) AS revenue", "lines")
    return number.unionByName(bars)
