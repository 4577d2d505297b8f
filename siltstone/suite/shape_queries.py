"""Widget shapes over orders, lineitem and events."""

from pyspark.sql import functions as F

from siltstone.functions.values import format_value, money
from siltstone.operators import shapes
from siltstone.suite.registry import query
from siltstone.suite.tables import table

STAGES = ["view", "click", "signup", "purchase"]


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("""
WITH p AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m,
                  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
           FROM orders GROUP BY 1, 2),
w AS (SELECT *, LAG(value) OVER (PARTITION BY o_orderpriority ORDER BY m) AS previous FROM p)
SELECT o_orderpriority, strftime(m, '%Y-%m-%d') AS period, value, previous,
       CASE WHEN previous IS NULL THEN NULL WHEN previous > 0 THEN (value - previous) / previous * 100 ELSE 0.0 END AS change_pct
FROM w
""")
def period_change(spark, root):
    out = shapes.period_change(
        table(spark, root, "orders"), "month", F.sum(money("o_totalprice")), "o_orderdate", ["o_orderpriority"]
    )
    return out.withColumn("period", _day("period"))


@query("""
WITH s(step, stage) AS (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase')),
n AS (SELECT step, stage, (SELECT COUNT(DISTINCT user_id) FROM events WHERE event_type = stage) AS value FROM s)
SELECT step, stage, value, value / FIRST_VALUE(value) OVER (ORDER BY step) * 100 AS width,
       ROUND(value / LAG(value) OVER (ORDER BY step) * 100, 1) AS conversion
FROM n
""")
def funnel(spark, root):
    return shapes.funnel(table(spark, root, "events"), "event_type", "user_id", STAGES)


@query("""
WITH s(step, stage) AS (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase')),
n AS (SELECT step, stage, COUNT(e.event_id) AS value FROM s LEFT JOIN events e ON e.event_type = s.stage GROUP BY 1, 2)
SELECT step, stage, value, value / FIRST_VALUE(value) OVER (ORDER BY step) * 100 AS width,
       ROUND(value / LAG(value) OVER (ORDER BY step) * 100, 1) AS conversion
FROM n
""")
def funnel_of_counts(spark, root):
    steps = F.create_map(*[x for i, s in enumerate(STAGES, 1) for x in (F.lit(s), F.lit(i))])
    counts = (
        table(spark, root, "events")
        .filter(F.col("event_type").isin(STAGES))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(steps[F.col("event_type")].alias("step"), F.col("event_type").alias("stage"), "value")
    )
    return shapes.funnel_of_counts(counts)


@query("""
WITH v AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM orders GROUP BY 1),
t AS (SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC, o_custkey) AS rank FROM v),
x AS (SELECT date_trunc('year', MAX(o_orderdate)) AS y FROM orders),
r AS (SELECT o_custkey,
             SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE date_trunc('year', o_orderdate) = y) AS cur,
             SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE date_trunc('year', o_orderdate) = y - INTERVAL 1 YEAR) AS prev
      FROM orders, x GROUP BY 1)
SELECT CAST(rank AS INTEGER) AS rank, t.o_custkey AS label, CAST(value AS DOUBLE) AS value,
       CASE WHEN COALESCE(prev, 0) > 0
            THEN ROUND((CAST(COALESCE(cur, 0) AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100, 1)
            ELSE 0.0 END AS trend
FROM t JOIN r USING (o_custkey) WHERE rank <= 25
""")
def leaderboard(spark, root):
    return shapes.leaderboard(
        table(spark, root, "orders"), "o_custkey", F.sum(money("o_totalprice")), "o_orderdate", "year", 25
    )


@query("""
SELECT p_type AS name, CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
       CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE)
       / CAST(SUM(SUM(CAST(p_retailprice AS DECIMAL(18,2)))) OVER () AS DOUBLE) * 100 AS share
FROM part GROUP BY 1
""")
def share(spark, root):
    return shapes.share(table(spark, root, "part"), "p_type", F.sum(money("p_retailprice")))


@query("""
SELECT c_mktsegment, COUNT(*) AS customers,
       LEAST(CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0::DOUBLE * 100, 100.0) AS progress
FROM customer GROUP BY 1
""")
def progress(spark, root):
    total = F.sum(money("c_acctbal")).cast("double")
    return table(spark, root, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), shapes.progress(total, F.lit(1_000_000.0)).alias("progress")
    )


_HOURS = ",\n".join(
    f"CAST(COUNT(*) FILTER (WHERE hour(ts) = {h}) AS DOUBLE) / 100 AS h{h:02d}" for h in range(24)
)


@query(f"SELECT CAST(isodow(ts) AS INTEGER) AS weekday, {_HOURS} FROM events GROUP BY 1")
def heatmap(spark, root):
    return shapes.heatmap(table(spark, root, "events"), "ts", F.count(F.lit(1)))


@query("""
SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS year,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS "O",
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS "F",
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS "P"
FROM orders GROUP BY 1
""")
def series(spark, root):
    year = _day(F.date_trunc("year", "o_orderdate"))
    return shapes.series(
        table(spark, root, "orders"), year, "year", "o_orderstatus", ["O", "F", "P"], F.sum(money("o_totalprice"))
    )


@query("""
SELECT p_type, p_brand, CAST(2 - GROUPING(p_type) - GROUPING(p_brand) AS INTEGER) AS depth,
       CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM part GROUP BY ROLLUP (p_type, p_brand)
""")
def treemap(spark, root):
    return shapes.treemap(table(spark, root, "part"), ["p_type", "p_brand"], F.sum(money("p_retailprice")))


@query("""
WITH d AS (SELECT date_trunc('week', ts) AS step,
                  SUM(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * CAST(value AS DECIMAL(18,2))) AS delta
           FROM events GROUP BY 1)
SELECT strftime(step, '%Y-%m-%d') AS step, CAST(delta AS DOUBLE) AS delta,
       CAST(SUM(delta) OVER (ORDER BY step) - delta AS DOUBLE) AS start,
       CAST(SUM(delta) OVER (ORDER BY step) AS DOUBLE) AS "end"
FROM d
""")
def waterfall(spark, root):
    signed = F.when(F.col("event_type") == "error", -money("value")).otherwise(money("value"))
    out = shapes.waterfall(table(spark, root, "events"), "ts", "week", F.sum(signed))
    return out.withColumn("step", _day("step"))


@query("""
WITH n AS (SELECT event_type, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)
SELECT event_type AS source, target, COUNT(*) AS weight FROM n WHERE target IS NOT NULL GROUP BY 1, 2
""")
def flows(spark, root):
    return shapes.flows(table(spark, root, "events"), "user_id", "ts", "event_id", "event_type")


@query("""
WITH d AS (SELECT user_id, date_trunc('day', ts) AS t, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v
           FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(printf('%.2f', v), ',' ORDER BY t) AS points, COUNT(*) AS n FROM d GROUP BY 1
""")
def sparkline(spark, root):
    lines = shapes.sparkline(table(spark, root, "events"), "user_id", "ts", "day", F.sum(money("value")))
    text = F.concat_ws(",", F.transform("points", lambda v: v.cast("decimal(18,2)").cast("string")))
    return lines.select("user_id", text.alias("points"), F.size("points").cast("long").alias("n"))


@query("""
WITH a AS (SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
                  CAST(COUNT(*) AS DOUBLE) AS lines, MAX(l_extendedprice) AS largest
           FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_returnflag || '/' || l_linestatus AS grp, quantity, lines, largest FROM a)
SELECT grp,
  COALESCE((quantity - MIN(quantity) OVER ()) / NULLIF(MAX(quantity) OVER () - MIN(quantity) OVER (), 0), 0) * 100 AS quantity,
  COALESCE((lines - MIN(lines) OVER ()) / NULLIF(MAX(lines) OVER () - MIN(lines) OVER (), 0), 0) * 100 AS lines,
  COALESCE((largest - MIN(largest) OVER ()) / NULLIF(MAX(largest) OVER () - MIN(largest) OVER (), 0), 0) * 100 AS largest
FROM g
""")
def radar(spark, root):
    lines = table(spark, root, "lineitem").withColumn("grp", F.concat("l_returnflag", F.lit("/"), "l_linestatus"))
    return shapes.radar(
        lines, "grp",
        {"quantity": F.sum(money("l_quantity")), "lines": F.count(F.lit(1)), "largest": F.max("l_extendedprice")},
    )


@query("""
SELECT l_suppkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS x,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS y, CAST(COUNT(*) AS DOUBLE) AS size
FROM lineitem GROUP BY 1
""")
def bubble(spark, root):
    return shapes.scatter(
        table(spark, root, "lineitem"), "l_suppkey", F.sum(money("l_quantity")), F.sum(money("l_extendedprice")),
        F.count(F.lit(1)),
    )


@query("""
SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20
""")
def activity_feed(spark, root):
    return shapes.feed(table(spark, root, "events"), "ts", "event_id").select("event_id", "event_type", "user_id")


@query("""
SELECT o_orderkey,
       '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
         || CASE WHEN cents = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(cents AS VARCHAR), 2, '0'), '0') END AS currency,
       format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
         || CASE WHEN cents = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(cents AS VARCHAR), 2, '0'), '0') END AS number,
       regexp_replace(CAST(o_totalprice AS VARCHAR), '[.]0$', '') || '%' AS percentage,
       CASE WHEN o_totalprice >= 3600 THEN CAST(CAST(floor(o_totalprice / 3600) AS BIGINT) AS VARCHAR) || 'h ' ELSE '' END
         || CAST(CAST(floor((o_totalprice % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm' AS duration
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 100 AS cents FROM orders)
""")
def formatted_values(spark, root):
    price = F.col("o_totalprice")
    styles = ("currency", "number", "percentage", "duration")
    return table(spark, root, "orders").select("o_orderkey", *[format_value(price, s).alias(s) for s in styles])


@query("""
SELECT n_name, COUNT(*) AS customers, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def region_map(spark, root):
    """Value per region, the key aggregated before the region's name is joined."""
    per_key = table(spark, root, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(money("c_acctbal")).cast("double").alias("value")
    )
    nation = table(spark, root, "nation")
    return per_key.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", "value")
