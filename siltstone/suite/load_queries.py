"""Loads, layers, files and streams; each query writes below the shared work folder."""

from pyspark.sql import functions as F

from siltstone.functions.values import FULL_TIMES
from siltstone.operators import buckets as B
from siltstone.operators import layers as L
from siltstone.operators import sync as S
from siltstone.operators import versions as V
from siltstone.operators.layers import Lake
from siltstone.session import union_all, work_dir
from siltstone.sources import documents as D
from siltstone.sources import archives, export, files
from siltstone.sources import social as P
from siltstone.sources import tables as TB
from siltstone.sources import untyped
from siltstone.streaming import stream as ST
from siltstone.suite.registry import query
from siltstone.suite.tables import SCHEMAS, table


def _lake(spark, label):
    return Lake(work_dir(spark, label))


def _text_date(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


BASE = "o_orderdate < TIMESTAMP_NTZ'2000-01-01'"
LATER = "o_orderdate >= TIMESTAMP_NTZ'1999-06-01'"


@query("""
WITH u AS (
  SELECT o_orderkey, o_totalprice, o_orderdate, 0 AS incoming FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
  UNION ALL
  SELECT o_orderkey, o_totalprice * 2, o_orderdate + INTERVAL 1 DAY, 1 FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, incoming DESC) AS rn FROM u)
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM r WHERE rn = 1
""")
def merge_orders(spark, root):
    """A stored table after merging an increment that changes old rows, adds new ones and is sent twice."""
    lake = _lake(spark, "merge")
    orders = table(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    later = orders.filter(LATER).select(
        "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("o_orderdate"),
    )
    path = lake.bronze("shop", "orders")
    V.merge_into(orders.filter(BASE), path, ["o_orderkey"], "o_orderdate")
    for _ in range(2):
        V.merge_into(later, path, ["o_orderkey"], "o_orderdate")
    return _text_date(V.read(spark, path), "o_orderdate")


@query("""
WITH u AS (
  SELECT *, 0 AS incoming, NULL AS note FROM orders
  UNION ALL
  SELECT o_orderkey + CASE WHEN o_orderkey % 2000 = 1 THEN 100000000 ELSE 0 END, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate, o_orderpriority, 1, 'changed'
  FROM orders WHERE o_orderkey % 1000 = 1),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, incoming DESC) AS rn FROM u)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority, note
FROM r WHERE rn = 1
""")
def pruned_merge(spark, root):
    """A table dealt by its key after an upsert that changes some rows, adds others and a column; only touched partitions are rewritten."""
    path = work_dir(spark, "buckets")
    orders = table(spark, root, "orders")
    B.create(orders, path, ["o_orderkey"], 64, "o_orderdate")
    some = orders.filter("o_orderkey % 1000 = 1")
    moved = F.when(F.col("o_orderkey") % 2000 == 1, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey"))
    changed = some.withColumns({"o_orderkey": moved, "o_totalprice": F.col("o_totalprice") + 1, "note": F.lit("changed")})
    B.upsert(changed, path)
    return _text_date(B.read(spark, path), "o_orderdate")


@query("""
WITH base AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-07-01' AND o_orderpriority != '1-URGENT'),
m AS (SELECT MAX(o_orderdate) AS m FROM base)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM base
UNION ALL
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders, m WHERE o_orderdate > m
""")
def incremental_silver(spark, root):
    """A refined table that takes only rows above its newest cursor value; earlier and equal ones are skipped."""
    lake = _lake(spark, "incremental")
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    cut = F.lit("1999-07-01").cast("timestamp_ntz")
    L.write_bronze(lake, "shop", "orders", orders.filter((F.col("o_orderdate") < cut) & (F.col("o_orderpriority") != "1-URGENT")))
    L.materialize(spark, lake, "shop", "orders", "incremental", "o_orderdate")
    L.write_bronze(lake, "shop", "orders", orders)
    L.materialize(spark, lake, "shop", "orders", "incremental", "o_orderdate")
    return _text_date(spark.table("shop__orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type
FROM events
""")
def incremental_load(spark, root):
    """Two cursor loads of a source that grows in between equal one full load; NULL types are kept."""
    lake = _lake(spark, "load")
    events = table(spark, root, "events").select(
        "event_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type")
    )
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (events.filter(F.col("ts") < half), events):
        S.load_incremental(lake, "app", "events", part, ["event_id"], "ts", "1970-01-01T00:00:00")
    return _text_date(V.read(spark, lake.bronze("app", "events")), "ts")


@query("""
SELECT 'customer' AS table, 'success' AS status, 'replace' AS mode, false AS is_incremental, COUNT(*) AS rows_synced, CAST(0 AS BIGINT) AS schema_changes FROM customer
UNION ALL SELECT 'supplier', 'success', 'replace', false, COUNT(*), 0 FROM supplier
UNION ALL SELECT 'nation', 'success', 'replace', false, COUNT(*), 0 FROM nation
""")
def sync_report(spark, root):
    """Full loads of three tables with their report."""
    lake = _lake(spark, "report")
    names = ["customer", "supplier", "nation"]
    report = S.run(lake, "shop", {n: table(spark, root, n) for n in names})
    return report.select("table", "status", "mode", "is_incremental", "rows_synced", "schema_changes")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def bronze_columns(spark, root):
    """Raw write and a read of three columns."""
    lake = _lake(spark, "bronze")
    L.write_bronze(lake, "shop", "orders", table(spark, root, "orders"))
    return L.read_bronze(spark, lake, "shop", "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("""
SELECT 'orders' AS table, 'success' AS status, 'incremental' AS type,
       COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-07-01' OR o_orderdate >= m) AS rows
FROM orders, (SELECT MAX(o_orderdate) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1999-07-01')
UNION ALL SELECT 'part', 'success', 'table', COUNT(*) FROM part
UNION ALL SELECT 'lineitem', 'success', 'view', 0
UNION ALL SELECT 'missing', 'error', NULL, 0
""")
def materialize_all(spark, root):
    """All three strategies, by what is declared of each raw table of a source; one of them does not exist."""
    lake = _lake(spark, "silver")
    orders = table(spark, root, "orders")
    L.write_bronze(lake, "shop", "orders", orders.filter(F.col("o_orderdate") < F.lit("1999-07-01").cast("timestamp_ntz")))
    for name in ("lineitem", "part"):
        L.write_bronze(lake, "shop", name, table(spark, root, name))
    cursors, keys = {"orders": "o_orderdate"}, {"orders": ["o_orderkey"], "part": ["p_partkey"]}
    L.materialize_all(spark, lake, "shop", ["orders"], cursors, keys=keys)
    L.write_bronze(lake, "shop", "orders", orders)
    report = L.materialize_all(spark, lake, "shop", ["orders", "lineitem", "part", "missing"], cursors, keys=keys)
    return report.select("table", "status", "type", "rows")


@query("""
WITH f AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS moved_at,
         CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM orders)
SELECT s.strategy, o_orderkey, strftime(moved_at, '%Y-%m-%d %H:%M:%S') AS moved_at, state
FROM f, (VALUES ('full'), ('incremental')) s(strategy)
""")
def silver_updates(spark, root):
    """After updated, added, tied and undated rows a full and an incremental refresh hold the same rows."""
    lake = _lake(spark, "updates")
    shown = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("moved_at")
    orders = table(spark, root, "orders").select("o_orderkey", shown)
    newest = F.lit("2002-01-01").cast("timestamp_ntz")
    first = orders.filter("o_orderkey % 5 != 0").withColumn("state", F.lit("old"))
    # The update of a row moves its cursor on; it is shown again by its date at the end.
    later = F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise("old")
    moved = F.when(((F.col("o_orderkey") % 3 == 0) | (F.col("o_orderkey") % 5 == 0)) & F.col("moved_at").isNotNull(), newest)
    second = orders.select("o_orderkey", F.coalesce(moved, "moved_at").alias("moved_at"), later.alias("state"))
    results = []
    for strategy in ("full", "incremental"):
        name = f"orders_{strategy}"
        for rows in (first, second):
            L.write_bronze(lake, "shop", name, rows)
            L.materialize(spark, lake, "shop", name, strategy, "moved_at", key=["o_orderkey"])
        results.append(V.read(spark, lake.silver("shop", name)).select(F.lit(strategy).alias("strategy"), "o_orderkey", "state"))
    return _text_date(union_all(results).join(orders, "o_orderkey").select("strategy", "o_orderkey", "moved_at", "state"), "moved_at")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def view_follows(spark, root):
    """A table refined as a view shows the raw rows of the second write."""
    lake = _lake(spark, "follows")
    orders = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    L.write_bronze(lake, "shop", "followed", orders.filter("o_orderkey < 100"))
    L.materialize(spark, lake, "shop", "followed")
    L.write_bronze(lake, "shop", "followed", orders)
    return spark.table("shop__followed")


@query("""
SELECT 'customer' AS table, CAST(2 AS BIGINT) AS version, COUNT(*) AS rows FROM customer
UNION ALL SELECT 'supplier', 1, COUNT(*) FROM supplier
""")
def stored_tables(spark, root):
    """What a lake holds after one table was written twice, one once and one dropped."""
    lake = _lake(spark, "stored")
    names = ["customer", "supplier", "nation"]
    for name in [*names, "customer"]:
        L.write_bronze(lake, "shop", name, table(spark, root, name))
    L.drop(spark, lake, "bronze", "shop", "nation")
    V.clean(spark, lake.bronze("shop", "customer"))
    stored = L.stored_tables(spark, lake, "bronze", "shop", names)
    counts = {n: V.read(spark, lake.bronze("shop", n)).count() for n in ("customer", "supplier")}
    actual = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("table"))
    return stored.select("table", "version", F.when(F.col("rows") == actual, F.col("rows")).alias("rows"))


@query("""
WITH f AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts FROM events)
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM f
""")
def append_without_key(spark, root):
    """Three loads by a cursor alone: rows without a value, rows tied with the newest and repeats come once."""
    lake = _lake(spark, "append")
    shown = F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts")
    events = table(spark, root, "events").select("event_id", "user_id", shown)
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    early = events.filter((F.col("ts") < half) | F.col("ts").isNull())
    for rows in (early, events, events):
        S.load(lake, "app", "events", rows, cursor="ts", incremental=True)
    return _text_date(V.read(spark, lake.bronze("app", "events")), "ts")


@query("""
SELECT 'orders' AS table_name, c AS column_name, k AS change_type, o AS old_type, n AS new_type, r AS requires_review,
       (SELECT COUNT(*) FROM orders) AS row_count
FROM (VALUES ('o_orderpriority', 'column_removed', 'VARCHAR', NULL, true),
             ('o_custkey', 'type_changed', 'BIGINT', 'VARCHAR', true),
             ('channel', 'column_added', NULL, 'VARCHAR', false)) v(c, k, o, n, r)
""")
def schema_drift(spark, root):
    """Changes found between two loads of a table."""
    lake = _lake(spark, "drift")
    orders = table(spark, root, "orders")
    L.write_bronze(lake, "shop", "orders", orders)
    changed = orders.drop("o_orderpriority").withColumns(
        {"o_custkey": F.col("o_custkey").cast("string"), "channel": F.lit("web")}
    )
    changes = L.write_bronze(lake, "shop", "orders", changed)
    return changes.withColumn("row_count", V.read(spark, lake.bronze("shop", "orders")).agg(F.count(F.lit(1))).scalar())


@query("SELECT MAX(o_orderdate)::VARCHAR AS high_water_mark FROM orders")
def high_water_mark(spark, root):
    mark = TB.high_water_mark(table(spark, root, "orders"), "o_orderdate")
    return mark.select(F.date_format("high_water_mark", "yyyy-MM-dd HH:mm:ss").alias("high_water_mark"))


@query("""
SELECT CAST(o_orderkey // 1000 AS VARCHAR) || '.tar.gz' AS archive,
       CASE o_orderkey % 3 WHEN 0 THEN 'a.csv' WHEN 1 THEN 'b/c.csv' ELSE 'd.parquet' END AS member,
       o_orderkey, o_totalprice, o_orderpriority || chr(10) || '"x", y' AS note
FROM orders
""")
def archived_orders(spark, root):
    """Orders written to an archive per thousand keys, each with two CSV members and one of Parquet, and read back."""
    folder = work_dir(spark, "archives")
    orders = table(spark, root, "orders").select(
        F.floor(F.col("o_orderkey") / 1000).cast("string").alias("name"),
        (F.col("o_orderkey") % 3).alias("part"),
        "o_orderkey",
        "o_totalprice",
        F.concat("o_orderpriority", F.lit('\n"x", y')).alias("note"),
    )

    def pack(key, rows):
        import io
        import tarfile

        import pandas as pd
        from pyarrow import fs

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for part, member in enumerate(("a.csv", "b/c.csv", "d.parquet")):
                own = rows[rows["part"] == part][["o_orderkey", "o_totalprice", "note"]]
                data = own.to_parquet(index=False) if part == 2 else own.to_csv(index=False).encode()
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{key[0]}.tar.gz", compression=None) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"name": [key[0]]})

    orders.groupBy("name").applyInPandas(pack, "name string").write.format("noop").mode("overwrite").save()
    rows = archives.read_archives(spark, folder, "o_orderkey bigint, o_totalprice double, note string")
    return rows.withColumn("archive", F.substring_index("archive", "/", -1))


@query("""
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, 'replace' AS mode, false AS is_incremental FROM customer
""")
def reload_after_change(spark, root):
    """An increment whose column changed its type cannot be merged and is reloaded in full."""
    lake = _lake(spark, "reload")
    customer = table(spark, root, "customer").select("c_custkey", "c_nationkey")
    S.load(lake, "shop", "customer", customer, ["c_custkey"], incremental=True)
    changed = customer.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    report = S.load(lake, "shop", "customer", changed, ["c_custkey"], incremental=True)
    return V.read(spark, lake.bronze("shop", "customer")).withColumns(
        {"mode": F.lit(report["mode"]), "is_incremental": F.lit(report["is_incremental"])}
    )


@query("SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def cursor_scan(spark, root):
    """Rows above a cursor value; the filter is pushed to the scan."""
    last = F.lit("2024-01-20").cast("timestamp_ntz")
    return TB.read_since(table(spark, root, "events"), "ts", last).select("event_id", "user_id", "value")


@query("""
SELECT sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') || '-'
       || ROW_NUMBER() OVER (PARTITION BY n_name, n_regionkey) AS id, n_name, n_regionkey
FROM (SELECT 'N' || (o_custkey % 10) AS n_name, CAST(o_custkey % 3 AS INTEGER) AS n_regionkey FROM orders)
""")
def keyed_csv(spark, root):
    """CSV written and read back with content-based ids, most rows being copies of each other."""
    path = work_dir(spark, "csv")
    rows = table(spark, root, "orders").select(
        F.concat(F.lit("N"), F.col("o_custkey") % 10).alias("n_name"), (F.col("o_custkey") % 3).alias("n_regionkey")
    )
    rows.write.option("header", True).csv(path)
    return files.read_csv(spark, path)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, root):
    """CSV with inferred types."""
    path = work_dir(spark, "csv")
    table(spark, root, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path, key=False).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_id > 100
""")
def documents_since(spark, root):
    """Events as JSON documents, read after a key, times as ISO text at depth."""
    path = work_dir(spark, "json")
    events = table(spark, root, "events")
    events.select(
        F.format_string("%012d", "event_id").alias("_id"), F.struct("ts", F.from_json("props", "k bigint").alias("p")).alias("body")
    ).write.options(**FULL_TIMES).json(path)
    docs = D.read_documents(
        spark, path, "_id string, body struct<ts: timestamp_ntz, p: struct<k: bigint>>", after="000000000100"
    )
    flat = D.flatten(D.normalize_values(docs))
    precise = F.when(F.length("body__ts") == 19, F.concat("body__ts", F.lit(".000000"))).otherwise(F.col("body__ts"))
    return flat.select(F.col("_id").cast("long").alias("event_id"), precise.alias("at"), F.col("body__p__k").alias("k"))


@query("""
SELECT event_id AS _id,
       CASE event_type WHEN 'view' THEN 'u' || user_id WHEN 'click' THEN '{"id":' || user_id || '}' ELSE user_id::VARCHAR END AS who,
       CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS props__k,
       CASE WHEN event_type = 'purchase' THEN 'C' || (event_id % 7) END AS props__coupon__code,
       CASE WHEN event_type = 'click' THEN event_id % 2 = 0 END AS "props__left side",
       CASE WHEN event_id % 5 = 0 THEN event_type || ',' || (event_id % 3) END AS tags,
       CASE WHEN event_id % 11 = 0 THEN '{"_id": ' || event_id || ', cut' END AS rejected
FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, '{"_id": ' || event_id || ', cut' FROM events WHERE event_id % 11 = 0
""")
def untyped_events(spark, root):
    """Events as documents whose shape depends on their type, every eleventh cut off, read without a schema."""
    path = work_dir(spark, "untyped")
    kind, uid, n = F.col("event_type"), F.col("user_id"), F.col("event_id")
    k = F.from_json("props", "k bigint")["k"].alias("k")
    tags = F.when(n % 5 == 0, F.array(kind, (n % 3).cast("string"))).alias("tags")
    text = (
        F.when(n % 11 == 0, F.format_string('{"_id": %d, cut', n))
        .when(kind == "view", F.to_json(F.struct(n.alias("_id"), F.concat(F.lit("u"), uid).alias("who"), tags)))
        .when(kind == "click", F.to_json(F.struct(
            n.alias("_id"), F.struct(uid.alias("id")).alias("who"), F.struct(k, (n % 2 == 0).alias("left side")).alias("props"), tags)))
        .when(kind == "purchase", F.to_json(F.struct(
            n.alias("_id"), uid.alias("who"), F.struct(k, F.struct(F.concat(F.lit("C"), n % 7).alias("code")).alias("coupon")).alias("props"), tags)))
        .otherwise(F.to_json(F.struct(n.alias("_id"), uid.alias("who"), F.struct(k).alias("props"), tags)))
    )
    table(spark, root, "events").select(text.alias("value")).write.text(path)
    docs = untyped.read(spark, path)
    found = untyped.shred(docs, untyped.merged_type(docs))
    return found.withColumn("tags", F.concat_ws(",", "tags")).withColumn("tags", F.when(F.col("tags") != "", F.col("tags")))


@query("""
SELECT CAST(vec_id AS VARCHAR) AS parent_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS list_idx,
       CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings
""")
def nested_children(spark, root):
    """Lists as a child table."""
    tables = D.unnest_children(table(spark, root, "embeddings"), "embeddings", "vec_id")
    return tables["embeddings__embedding"].select("parent_id", "list_idx", F.col("value").cast("double").alias("value"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, root):
    return table(spark, root, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def posts(spark, root):
    """Documents as posts of three platforms, in the shape each platform delivers, and some of a fourth."""
    d = table(spark, root, "documents")
    kind = F.when(F.col("lang") == "en", "Reddit").when(F.col("lang") == "fr", "x").when(F.col("lang") == "de", "LinkedIn").otherwise("other")
    reddit = F.to_json(
        F.struct(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("selftext"), F.col("n_chars").alias("ups"),
                          F.col("source").alias("url")).alias("data"))
    )
    x = F.to_json(
        F.struct(F.struct(F.col("doc_id").alias("id"), "text",
                          F.struct(F.col("n_chars").alias("like_count"), F.lit(2).alias("retweet_count")).alias("public_metrics")).alias("data"))
    )
    linkedin = F.to_json(
        F.struct(F.concat(F.lit("urn:"), "doc_id").alias("urn"), F.col("text").alias("commentary"),
                 F.array(F.struct(F.col("source").alias("url"))).alias("media"), F.struct(F.col("n_chars").alias("likes")).alias("metrics"))
    )
    payload = F.when(F.col("lang") == "en", reddit).when(F.col("lang") == "fr", x).otherwise(linkedin)
    return d.select("doc_id", kind.alias("platform"), payload.alias("payload"))


@query("""
SELECT CASE lang WHEN 'en' THEN 'reddit' WHEN 'fr' THEN 'x' ELSE 'linkedin' END AS platform,
       CASE lang WHEN 'de' THEN 'urn:' ELSE '' END || CAST(doc_id AS VARCHAR) AS external_id,
       COALESCE(text, '') AS content, CASE lang WHEN 'fr' THEN '' ELSE source END AS media,
       n_chars AS likes, CASE lang WHEN 'fr' THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS shares
FROM documents WHERE lang IN ('en', 'fr', 'de')
""")
def social_posts(spark, root):
    out = P.normalize(posts(spark, root))
    return out.select(
        "platform", "external_id", "content", F.array_join("media_urls", ",").alias("media"),
        F.col("metrics.likes").alias("likes"), F.col("metrics.shares").alias("shares"),
    )


@query("SELECT doc_id, 'other' AS platform FROM documents WHERE lang NOT IN ('en', 'fr', 'de')")
def social_rejects(spark, root):
    return P.rejects(posts(spark, root)).select("doc_id", "platform")


@query("""
SELECT 'Orders by status' AS widget, o_orderstatus, COUNT(*) AS orders, NULL::VARCHAR AS c_mktsegment, NULL::VARCHAR AS nations FROM orders GROUP BY 2
UNION ALL
SELECT 'Segments', NULL, NULL, c_mktsegment, '[' || string_agg(DISTINCT c_nationkey, ',' ORDER BY c_nationkey) || ']' FROM customer GROUP BY 4
""")
def exported_widgets(spark, root):
    """Two widgets with different columns, one with lists, written as JSON lines and read back together."""
    path = work_dir(spark, "export")
    by_status = table(spark, root, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    segments = table(spark, root, "customer").groupBy("c_mktsegment").agg(
        F.array_sort(F.collect_set("c_nationkey")).alias("nations")
    )
    both = export.combine({"Orders by status": by_status, "Segments": segments})
    export.to_json({"all": both}, path)
    schema = "widget string, o_orderstatus string, orders bigint, c_mktsegment string, nations string"
    return spark.read.schema(schema).json(f"{path}/00_all")


@query("SELECT o_orderstatus, COUNT(*) AS orders, AVG(o_custkey) AS customer FROM orders GROUP BY 1")
def exported_csv(spark, root):
    path = work_dir(spark, "export")
    widget = table(spark, root, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.avg("o_custkey").alias("customer")
    )
    folders = export.to_csv({"Orders by status": widget}, path)
    return files.read_csv(spark, folders["Orders by status"], "o_orderstatus string, orders bigint, customer double", key=False)


def _events_stream(spark, root):
    return ST.read_files(spark, root, SCHEMAS["events"], pathGlobFilter="events.parquet")


@query("""
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, COUNT(*) AS n
FROM events GROUP BY 1
""")
def stream_merge(spark, root):
    """A stream of events merged by user, newest event wins, joined to the user's event count."""
    path = work_dir(spark, "stream")
    stream = _events_stream(spark, root).select("user_id", "ts", "event_id", "event_type")
    ST.sync(stream, f"{path}/users", f"{path}/_checkpoint", ["user_id"], "ts", "stream_merge").awaitTermination()
    counts = table(spark, root, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return V.read(spark, f"{path}/users").select("user_id", "event_type").join(counts, "user_id")


@query("SELECT event_id, user_id, value FROM events")
def stream_append(spark, root):
    """A stream without a key, appended; run twice, the second run finds nothing new."""
    path = work_dir(spark, "stream")
    for _ in range(2):
        stream = _events_stream(spark, root).select("event_id", "user_id", "value")
        ST.sync(stream, f"{path}/events", f"{path}/_checkpoint", name="stream_append").awaitTermination()
    return V.read(spark, f"{path}/events")


@query("""
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2
""")
def stream_windows(spark, root):
    """Counts and sums per six hours and type, kept up to date by a stream."""
    path = work_dir(spark, "stream")
    stream = _events_stream(spark, root).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = ST.windowed(
        stream, "ts", "6 hours", "1 day", ["event_type"],
        {"events": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("decimal(18,2)"))},
    )
    ST.live_metric(windows, f"{path}/windows", f"{path}/_checkpoint", ["event_type"], "stream_windows").awaitTermination()
    out = V.read(spark, f"{path}/windows")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events",
        F.col("total").cast("double").alias("total"),
    )


@query("SELECT user_id, event_type, 1::BIGINT AS kept, COUNT(*) AS sent, TRUE AS known FROM events GROUP BY 1, 2")
def stream_dedupe(spark, root):
    """One row per user and type from a stream, the rest dropped as duplicates: the rows kept and sent, and whether the kept one was sent."""
    path = work_dir(spark, "stream")
    stream = _events_stream(spark, root).withColumn("ts", F.col("ts").cast("timestamp"))
    once = ST.dedupe(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type", "event_id")
    ST.sync(once, f"{path}/once", f"{path}/_checkpoint", name="stream_dedupe").awaitTermination()
    key = ["user_id", "event_type"]
    kept = V.read(spark, f"{path}/once").groupBy(*key).agg(F.count(F.lit(1)).alias("kept"), F.max("event_id").alias("_one"))
    sent = table(spark, root, "events").join(kept, key)
    return sent.groupBy(*key, "kept").agg(F.count(F.lit(1)).alias("sent"), F.max(F.col("event_id") == F.col("_one")).alias("known"))
