"""Joins by time, sessions and profiles that grow with their table."""

from pyspark.sql import functions as F

from siltstone.operators import profile as P
from siltstone.operators import sketches as K
from siltstone.operators import temporal as J
from siltstone.session import work_dir
from siltstone.streaming import stream as ST
from siltstone.suite.registry import query
from siltstone.suite.tables import SCHEMAS, table

DAY = 86_400_000_000


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts, MAX(event_id) AS click_id, arg_max(value, event_id) AS click_value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, c.click_id, c.click_value, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS clicked_at
FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def last_click(spark, root):
    """Every purchase with the user's newest click up to it."""
    events = table(spark, root, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"), F.col("ts").alias("at"), "ts"
    )
    found = J.as_of(bought, clicks, ["user_id"], "ts", "ts", ["click_id", "click_value", "at"], 2 * DAY, tie="click_id")
    return found.select("event_id", "user_id", "click_id", "click_value", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("clicked_at"))


@query("""
WITH a AS (SELECT event_id, user_id, ts AS s, ts + to_minutes(event_id % 600) AS e FROM events WHERE event_type = 'view'),
b AS (SELECT event_id, user_id, ts AS s, ts + to_minutes((event_id * 7) % 20000) AS e FROM events WHERE event_type = 'click')
SELECT a.event_id AS view_id, b.event_id AS click_id, a.user_id
FROM a JOIN b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e
""")
def overlapping_visits(spark, root):
    """Intervals of two kinds, from a minute to a fortnight long, that a user has at the same time."""
    events = table(spark, root, "events")

    def spans(kind, minutes):
        end = F.col("ts") + F.make_dt_interval(mins=F.expr(minutes).cast("int"))
        return events.filter(F.col("event_type") == kind).select("event_id", "user_id", F.col("ts").alias("s"), end.alias("e"))

    met = J.overlapping(spans("view", "event_id % 600"), spans("click", "(event_id * 7) % 20000"), ["user_id"], ("s", "e"), ("s", "e"))
    return met.select(F.col("l.event_id").alias("view_id"), F.col("r.event_id").alias("click_id"), F.col("l.user_id").alias("user_id"))


@query("""
WITH s AS (
  SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(MAX(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS ended,
       COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, MAX(event_id) AS last_id
FROM s GROUP BY user_id, session HAVING MAX(ts) + INTERVAL 2 HOUR <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_sessions(spark, root):
    """Sessions of users, two hours without an event apart, from the stream of events: those that its watermark has closed."""
    path = work_dir(spark, "sessions")
    stream = ST.read_files(spark, root, SCHEMAS["events"], pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    total = F.sum(F.col("value").cast("decimal(18,2)"))
    measures = {"events": F.count(F.lit(1)), "total": total, "last_id": F.max("event_id")}
    found = ST.sessions(stream, ["user_id"], "ts", "2 hours", "1 hour", measures)
    ST.keep_sessions(found, f"{path}/rows", f"{path}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(
        "user_id",
        F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"),
        F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"),
        "events",
        F.col("total").cast("double").alias("total"),
        "last_id",
    )


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal_position, COUNT(*) AS row_count, "
        f"ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 2) AS null_percentage, CAST(MIN({c}) AS VARCHAR) AS min, CAST(MAX({c}) AS VARCHAR) AS max, "
        "TRUE AS within_bound FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders)"
        for i, c in enumerate(ORDERS, 1)
    )
)
def profile_after_append(spark, root):
    """The profile of a table that grew in three loads, merged from the rows that each load left; the estimates are held against exact counts."""
    path = work_dir(spark, "profiles")
    blank = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    orders = table(spark, root, "orders").select(*ORDERS).withColumn("o_orderpriority", blank)
    for part in range(3):
        K.add(orders.filter(f"o_orderkey % 3 = {part}"), path)
    exact = P.count_exactly({"orders": orders}, [("orders", c) for c in ORDERS]).select("column_name", F.col("cardinality").alias("_exact"))
    near = F.abs(F.col("cardinality") - F.col("_exact")) <= K.DISTINCT_BOUND * F.col("_exact")
    found = K.profile(spark, path, "orders").join(exact, "column_name")
    return found.select("column_name", "ordinal_position", "row_count", "null_percentage", "min", "max", near.alias("within_bound"))
