"""Catalog, profiles and model discovery over the given tables and tables derived from them."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from siltstone.functions import names as N
from siltstone.operators import catalog as C
from siltstone.operators import drift as DR
from siltstone.operators import layers as L
from siltstone.operators import profile as P
from siltstone.plans import metrics as MQ
from siltstone.plans import model as M
from siltstone.plans import relate as R
from siltstone.session import pin, work_dir
from siltstone.suite.registry import query
from siltstone.suite.tables import table

ALL = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
LISTED = ", ".join(f"'{t}'" for t in ALL)

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "embeddings": ["vec_id", "embedding", "label"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _tables(spark, root, names):
    """The tables with the schemas that their files have."""
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(lambda n: spark.read.parquet(f"{root}/{n}.parquet"), names)))


def _keyed(spark, root):
    """Tables, their catalog with primary keys, and the measured key columns both come from."""
    tables = _tables(spark, root, ALL)
    columns = R.key_columns(tables, R.PREFIXED_KEYS)
    measured = R.measure(tables, columns, keep_at=work_dir(spark, "key-values"))
    unique = R.unique_keys(tables, measured)
    keyed = pin(R.primary_keys(C.describe(spark, tables), R.PREFIXED_KEYS, unique))
    return tables, keyed, measured


def shop(spark, root):
    """The given tables under the names a sales database would use."""
    lines = table(spark, root, "lineitem")
    cents = lambda c: F.round(c, 2)
    gross, discount = F.col("l_extendedprice"), cents(F.col("l_extendedprice") * F.col("l_discount"))
    fee, cost = cents(F.col("l_extendedprice") * F.col("l_tax")), cents(F.col("l_extendedprice") * 0.6)
    return {
        "conn_shop.regions": table(spark, root, "region").toDF("id", "name"),
        "conn_shop.nations": table(spark, root, "nation").toDF("id", "name", "region_id"),
        "conn_shop.customers": table(spark, root, "customer").toDF("id", "name", "nation_id", "balance", "segment"),
        "conn_shop.suppliers": table(spark, root, "supplier").toDF("id", "name", "nation_id", "balance"),
        "conn_shop.products": table(spark, root, "part").toDF("id", "name", "brand", "kind", "size", "list_price"),
        "conn_shop.orders": table(spark, root, "orders").toDF(
            "id", "customer_id", "status", "total_amount", "created_at", "priority"
        ),
        "conn_shop.order_items": lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_suppkey").cast("double").alias("supplier_id"),
            F.col("l_quantity").alias("quantity"),
            gross.alias("gross_amount"),
            discount.alias("discount_amount"),
            (gross - discount).alias("net_amount"),
            fee.alias("shipping_fee"),
            (gross + fee).alias("total_due"),
            gross.alias("sales_value"),
            cost.alias("cost_value"),
            ((gross - cost) * 1.02).alias("margin_value"),
        ),
        "conn_shop.activity": table(spark, root, "events").select("ts", "event_type", "value", F.col("user_id").alias("userid")),
        "conn_shop.users": table(spark, root, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("seen_at")),
    }


@query(f"""
SELECT c.table_name, c.column_name, CAST(c.ordinal_position AS INTEGER) AS ordinal_position, c.data_type,
       CAST(COUNT(*) OVER (PARTITION BY c.table_name) AS INTEGER) AS column_count, r.row_count
FROM information_schema.columns c
JOIN ({" UNION ALL ".join(f"SELECT '{t}' AS t, COUNT(*) AS row_count FROM {t}" for t in ALL)}) r ON r.t = c.table_name
WHERE c.table_name IN ({LISTED})
""")
def catalog_columns(spark, root):
    """Every column with its type and the row count of its table."""
    tables = _tables(spark, root, ALL)
    counts = L.row_counts(tables).select(F.col("model").alias("_m"), "row_count")
    return (
        C.describe(spark, tables)
        .join(counts, F.col("model") == F.col("_m"))
        .select("table_name", "column_name", "ordinal_position", "data_type", "column_count", "row_count")
    )


@query(f"""
SELECT table_name AS model,
       'CREATE TABLE ' || table_name || ' (' || chr(10)
       || string_agg('    ' || column_name || ' ' || data_type, ',' || chr(10) ORDER BY ordinal_position)
       || chr(10) || ');' AS ddl,
       CASE table_name {" ".join(f"WHEN '{t}' THEN (SELECT COUNT(*) FROM {t})" for t in ALL)} END AS row_count
FROM information_schema.columns WHERE table_name IN ({LISTED}) GROUP BY 1
""")
def catalog_ddl(spark, root):
    tables = _tables(spark, root, ALL)
    return C.ddl(C.describe(spark, tables)).join(L.row_counts(tables), "model")


def _profile_sql(names):
    parts = [
        f"SELECT '{t}' AS model, '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal_position, "
        f"COUNT(*) AS row_count, COUNT(DISTINCT {c}) AS cardinality, "
        f"ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 2) AS null_percentage, "
        + ("NULL AS min, NULL AS max" if c == "embedding" else f"CAST(MIN({c}) AS VARCHAR) AS min, CAST(MAX({c}) AS VARCHAR) AS max")
        + f" FROM {t}"
        for t in names
        for i, c in enumerate(COLUMNS[t], 1)
    ]
    return "\nUNION ALL\n".join(parts)


@query(_profile_sql(ALL))
def profile_exact(spark, root):
    """Exact profile of every column of every table."""
    return P.summarize_all(_tables(spark, root, ALL), exact=True)


@query(f"SELECT *, TRUE AS plausible FROM ({_profile_sql(ALL)})")
def profile_single_pass(spark, root):
    """The one-pass profile of all tables: whether its estimates of distinct values can be right, and the exact counts in their place."""
    tables = _tables(spark, root, ALL)
    found = P.summarize_all(tables)
    present = F.col("row_count") * (1 - F.col("null_percentage") / 100)
    few = F.when(F.col("min") == F.col("max"), F.col("cardinality") == 1).otherwise(F.col("cardinality") > 1)
    plausible = (F.col("cardinality") <= 1.15 * present) & (F.col("min").isNull() | few)
    exact = P.count_exactly(tables, [(model, c) for model, df in tables.items() for c in df.columns])
    return P.with_cardinality(found.withColumn("plausible", plausible), exact)


@query("""
SELECT n_name, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def metric_from_model(spark, root):
    """From tables to a metric in one chain: the relationships of the generated model are the path."""
    tables = _tables(spark, root, ["orders", "customer", "nation"])
    found = M.generate(spark, tables, R.PREFIXED_KEYS)
    revenue = MQ.Metric("revenue", "sum", "CAST(o_totalprice AS DECIMAL(18,2))")
    out = MQ.query_related(tables, MQ.edges(found.relationships), {"orders": [revenue, MQ.Metric("orders", "count")]}, ("nation", "n_name"))
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey - CASE WHEN o_orderkey % 33 = 0 THEN 1 ELSE 0 END AS nearly, 'n' || o_orderkey AS name FROM orders)
SELECT 'order_id' AS column_name, COUNT(DISTINCT o_orderkey) AS cardinality, true AS is_unique FROM o
UNION ALL SELECT 'nearly', COUNT(DISTINCT nearly), COUNT(DISTINCT nearly) >= 0.99 * COUNT(*) FROM o
UNION ALL SELECT 'name', COUNT(DISTINCT name), true FROM o
""")
def near_unique_columns(spark, root):
    """A column of 97 % distinct values is not unique in the generated model, whatever a sketch says."""
    key = F.col("o_orderkey")
    orders = table(spark, root, "orders").select(
        key.alias("order_id"), (key - F.when(key % 33 == 0, 1).otherwise(0)).alias("nearly"), F.concat(F.lit("n"), key).alias("name")
    )
    return M.generate(spark, {"orders": orders}).columns.select("column_name", "cardinality", "is_unique")


@query(f"""
SELECT model, column_name, row_count, cardinality FROM ({_profile_sql(ALL)})
WHERE row_count > 0 AND null_percentage = 0 AND cardinality >= row_count * 0.99
""")
def unique_columns(spark, root):
    return P.unique_columns(P.summarize_all(_tables(spark, root, ALL), exact=True))


_STEM = "regexp_extract(column_name, '^(?:[a-z]{1,2}_)?(.+?)_?(?:key|id)$', 1)"


@query(f"""
WITH p AS ({_profile_sql(ALL)}), s AS (SELECT *, {_STEM} AS stem FROM p)
SELECT model, column_name FROM s
WHERE stem != '' AND (contains(model, stem) OR contains(stem, model))
  AND row_count > 0 AND null_percentage = 0 AND cardinality >= row_count * 0.99
""")
def primary_keys(spark, root):
    """Key columns that name their own table and hold unique values."""
    _, keyed, _ = _keyed(spark, root)
    return keyed.filter("is_primary").select("model", "column_name")


@query(f"""
WITH p AS ({_profile_sql(ALL)}), s AS (SELECT *, {_STEM} AS stem FROM p),
fk AS (SELECT model AS fk_model, column_name AS fk_column, stem FROM s WHERE stem != ''),
pk AS (SELECT model AS pk_model, column_name AS pk_column FROM s
       WHERE stem != '' AND (contains(model, stem) OR contains(stem, model))
         AND row_count > 0 AND null_percentage = 0 AND cardinality >= row_count * 0.99),
form AS (SELECT w, unnest([w, CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END,
                           CASE WHEN w LIKE '%s' THEN w || 'es' ELSE w || 's' END]) AS f
         FROM (SELECT DISTINCT stem AS w FROM fk UNION SELECT DISTINCT pk_model FROM pk))
SELECT DISTINCT fk_model, fk_column, pk_model, pk_column
FROM fk JOIN pk ON fk_model != pk_model JOIN form a ON a.w = stem JOIN form b ON b.w = pk_model
WHERE contains(b.f, a.f) OR contains(a.f, b.f)
""")
def key_candidates(spark, root):
    """References and keys whose names go together (no pair of these tables is merely similar)."""
    _, keyed, _ = _keyed(spark, root)
    return R.candidates(keyed, R.PREFIXED_KEYS).select("fk_model", "fk_column", "pk_model", "pk_column")


FOREIGN_KEYS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]


def _inclusion_sql(pairs, fk_expr=lambda c: c, prefix=""):
    parts = [
        f"SELECT '{prefix}{pt}' AS \"from\", '{pc}' AS from_column, '{prefix}{ft}' AS \"to\", '{fc}' AS to_column, "
        f"COUNT(DISTINCT {fq}) AS total_count, "
        f"COUNT(DISTINCT {fq}) FILTER (WHERE {fq} IN (SELECT {pq} FROM {ps})) AS match_count FROM {fs}"
        for ft, fc, pt, pc, fs, fq, ps, pq in pairs
    ]
    return f"""
SELECT "from", from_column, "to", to_column, total_count, match_count,
       ROUND(match_count / total_count, 2) AS value_overlap,
       ROUND(0.75 + (match_count / total_count - 0.50) * 0.4, 2) AS confidence
FROM ({" UNION ALL ".join(parts)})
WHERE match_count / total_count >= 0.5 AND match_count >= 3
"""


_INCLUSION_COLUMNS = [
    "from", "from_column", "to", "to_column", "total_count", "match_count", "value_overlap", "confidence",
]


@query(_inclusion_sql([(ft, fc, pt, pc, ft, fc, pt, pc) for ft, fc, pt, pc in FOREIGN_KEYS]))
def inclusion_dependencies(spark, root):
    """All references among the given tables, found by name and confirmed by their values, which only sketches leave open."""
    tables = _tables(spark, root, ALL)
    sketched = pin(R.sketches(tables, R.key_columns(tables, R.PREFIXED_KEYS)))
    unique = R.unique_by_sketch(tables, sketched)
    keyed = pin(R.primary_keys(C.describe(spark, tables), R.PREFIXED_KEYS, unique))
    return R.inclusion(tables, R.candidates(keyed, R.PREFIXED_KEYS), sketched=sketched).select(*_INCLUSION_COLUMNS)


SHOP_KEYS = [
    ("orders", "customer_id", "customers", "id", "orders", "o_custkey", "customer", "c_custkey"),
    ("order_items", "order_id", "orders", "id", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("order_items", "product_id", "products", "id", "lineitem", "l_partkey", "part", "p_partkey"),
    ("order_items", "supplier_id", "suppliers", "id", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customers", "nation_id", "nations", "id", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("suppliers", "nation_id", "nations", "id", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nations", "region_id", "regions", "id", "nation", "n_regionkey", "region", "r_regionkey"),
]


@query(f"""
SELECT * EXCLUDE (total_count, match_count),
       CASE WHEN to_column = 'product_id' THEN true ELSE false END AS cast_applied, 'statistical' AS method,
       CASE WHEN confidence >= 0.9 THEN 'high' ELSE 'medium' END AS level
FROM ({_inclusion_sql(SHOP_KEYS, prefix="conn_shop.")})
""")
def model_relationships(spark, root):
    """Relationships of a whole discovered model: values first, names where values say nothing."""
    model = M.generate(spark, shop(spark, root))
    return model.relationships.select(
        "from", "from_column", "to", "to_column", "value_overlap", "confidence", "cast_applied", "method", "level"
    )


@query("""
WITH n AS (SELECT COUNT(*) AS events FROM events)
SELECT 'conn_shop' AS table_schema, 'conn_shop.' || unnest(['activity', 'users']) AS model FROM n WHERE events > 0
""")
def isolated_tables(spark, root):
    return M.generate(spark, shop(spark, root)).isolated_tables.select("table_schema", "model")


NAMED = {
    ("orders", "customer_id"): "customers", ("order_items", "order_id"): "orders", ("order_items", "product_id"): "products",
    ("order_items", "supplier_id"): "suppliers", ("customers", "nation_id"): "nations", ("suppliers", "nation_id"): "nations",
    ("nations", "region_id"): "regions",
}
GIVEN = {
    "orders": "orders", "order_items": "lineitem", "customers": "customer", "suppliers": "supplier", "nations": "nation",
}


@query(
    " UNION ALL ".join(
        f"SELECT 'conn_shop.{t}_{c}__conn_shop.{o}_id_naming' AS name, "
        f"{'0.8' if c == 'product_id' else '0.85'}::DOUBLE AS confidence, COUNT(*) AS row_count FROM {GIVEN[t]}"
        for (t, c), o in NAMED.items()
    )
)
def relationships_by_name(spark, root):
    """What the names alone tell, with the rows of the referring table."""
    tables = shop(spark, root)
    found = R.by_name(pin(R.primary_keys(C.describe(spark, tables))))
    return found.join(L.row_counts(tables), F.col("to") == F.col("model")).select("name", "confidence", "row_count")


@query("""
SELECT l_returnflag, COUNT(*) AS lines, COUNT(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def reconciled_join(spark, root):
    """A text reference joined to a numeric key, compared as text."""
    lines = table(spark, root, "lineitem").select("l_returnflag", F.col("l_partkey").cast("string").alias("product"))
    part = table(spark, root, "part").select("p_partkey", "p_brand")
    on = R.join_condition(
        F.col("product"), lines.schema["product"].dataType, F.col("p_partkey"), part.schema["p_partkey"].dataType
    )
    return lines.join(part, on).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("p_brand").alias("brands")
    )


@query("""
SELECT 'conn_shop.customers' AS model, COUNT(*) AS row_count FROM customer
UNION ALL SELECT 'part', COUNT(*) FROM part UNION ALL SELECT 'conn_one.dashboards2', COUNT(*) FROM region
""")
def discovered_tables(spark, root):
    """Business tables among loader, staging and application tables of several schemas."""
    region, part = table(spark, root, "region"), table(spark, root, "part")
    tables = {
        "conn_shop.customers": table(spark, root, "customer"), "conn_shop._dlt_loads": region, "part": part,
        "conn_shop.orders_staging": part, "conn_app.dashboards": region, "conn_app.otps": region, "conn_app.people": part,
        "conn_one.dashboards": region, "conn_one.dashboards2": region, "conn_shop_staging.part": part, "sync_runs": region,
    }
    return C.discover(C.describe(spark, tables)).select("model").distinct().join(L.row_counts(tables), "model")


@query(f"""
SELECT table_name, column_name, data_type,
  CASE
    WHEN column_name IN ('id', 'uuid') OR column_name IN ('event_id', 'page_id') AND table_name IN ('events', 'pages')
      THEN 'IDENTIFIER'
    WHEN regexp_matches(column_name, '_(id|key|uuid)$') THEN 'FOREIGN_KEY'
    WHEN data_type LIKE '%TIME%' OR data_type LIKE '%DATE%' THEN 'TEMPORAL'
    WHEN data_type = 'VARCHAR' AND regexp_matches(column_name, 'description|content|note|bio|body|message|comment|reason')
      THEN 'TEXT_LONG'
    WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') AND regexp_matches(column_name,
      'amount|price|cost|revenue|total|sum|count|quantity|qty|num|balance|value|fee|charge|score|rating|points|rank|'
      || 'weight|size|length|width|height|duration|minutes|hours|days|participants|enrolled|profit|margin|discount|tax|'
      || 'spent|budget|salary|wage|income|expense|debit|credit') THEN 'MEASURE'
    ELSE 'DIMENSION' END AS category,
  CASE WHEN category = 'MEASURE' THEN 'sum' END AS aggregation,
  CASE WHEN category = 'MEASURE' THEN CASE
    WHEN regexp_matches(column_name, 'count|quantity|num|participants|enrolled') THEN 'number'
    WHEN regexp_matches(column_name, 'amount|price|cost|revenue|total|value|balance|fee|charge|profit|salary|wage|income|'
      || 'expense|budget|spent|tax|discount') THEN 'currency' ELSE 'number' END END AS format,
  CASE table_name {" ".join(f"WHEN '{t}' THEN (SELECT COUNT(*) FROM {t})" for t in ALL)} END AS row_count
FROM information_schema.columns WHERE table_name IN ({LISTED})
""")
def column_classes(spark, root):
    tables = _tables(spark, root, ALL)
    counts = L.row_counts(tables)
    classified = M.classify(R.primary_keys(C.describe(spark, tables)))
    return classified.join(counts, "model").select(
        "table_name", "column_name", "data_type", "category", "aggregation", "format", "row_count"
    )


@query("""
SELECT 'lineitem' AS model, 'l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax' AS measures,
       'l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus' AS dimensions, 'l_shipdate' AS temporal_columns,
       COUNT(*) AS row_count FROM lineitem
UNION ALL
SELECT 'orders', 'o_totalprice', 'o_orderkey, o_custkey, o_orderstatus, o_orderpriority', 'o_orderdate', COUNT(*) FROM orders
UNION ALL
SELECT 'events', 'value', 'event_type, props', 'ts', COUNT(*) FROM events
""")
def column_roles(spark, root):
    """Measures, dimensions and temporal columns as lists."""
    tables = _tables(spark, root, ["lineitem", "orders", "events"])
    lists = M.roles(M.classify(R.primary_keys(C.describe(spark, tables)))).join(L.row_counts(tables), "model")
    return lists.select(
        "model",
        *[F.array_join(c, ", ").alias(c) for c in ("measures", "dimensions", "temporal_columns")],
        "row_count",
    )


@query("""
WITH d AS (
  SELECT l_extendedprice AS g, ROUND(l_extendedprice * l_discount, 2) AS disc, ROUND(l_extendedprice * l_tax, 2) AS fee,
         ROUND(l_extendedprice * 0.6, 2) AS cost FROM lineitem),
f AS (
  SELECT 'margin_value' AS result_column, 'sales_value - cost_value' AS formula, g - cost AS e, (g - cost) * 1.02 AS r FROM d
  UNION ALL SELECT 'net_amount', 'gross_amount - discount_amount', g - disc, g - disc FROM d
  UNION ALL SELECT 'total_due', 'gross_amount + shipping_fee', g + fee, g + fee FROM d)
SELECT 'order_items' AS table_name, result_column, formula, COUNT(*) AS rows,
       COUNT(*) FILTER (WHERE abs(e - r) < 0.01) AS exact_rows,
       COUNT(*) FILTER (WHERE abs(e - r) >= 0.01 AND r != 0 AND abs(e - r) < abs(r) * 0.05) AS approximate_rows,
       CASE WHEN COUNT(*) FILTER (WHERE abs(e - r) < 0.01) >= COUNT(*) * 0.6 THEN 'exact' ELSE 'approximate' END AS validation,
       CASE WHEN COUNT(*) FILTER (WHERE abs(e - r) < 0.01) >= COUNT(*) * 0.6 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence
FROM f GROUP BY 1, 2, 3
""")
def computed_columns(spark, root):
    return M.computed_columns(shop(spark, root)).select(
        "table_name", "result_column", "formula", "rows", "exact_rows", "approximate_rows", "validation", "confidence"
    )


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
i(a, b) AS (VALUES ('person','people'),('child','children'),('man','men'),('woman','women'),('datum','data'),
            ('medium','media'),('analysis','analyses'),('status','statuses')),
both_ways AS (SELECT a, b FROM i UNION ALL SELECT b, a FROM i)
SELECT word,
  COALESCE(b, CASE WHEN word LIKE '_%ies' THEN left(word, -3) || 'y' WHEN word LIKE '_%ses' THEN left(word, -2)
    WHEN word LIKE '%ches' OR word LIKE '%shes' THEN left(word, -2)
    WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, -1) ELSE word END) AS singular,
  COALESCE(b, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, -1) || 'ies'
    WHEN regexp_matches(word, '(s|sh|ch|x|z)$') THEN word || 'es' ELSE word || 's' END) AS plural
FROM w LEFT JOIN both_ways ON a = word
""")
def word_forms(spark, root):
    """Singular and plural of every distinct word of the documents."""
    words = table(spark, root, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word")
    ).distinct()
    return words.select("word", N.singular(F.col("word")).alias("singular"), N.plural(F.col("word")).alias("plural"))


@query("""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '^(.*[^./].*)\\.[^./]*$', '\\1', 's'), '[^a-zA-Z0-9]', '_', 'g') AS p
           FROM pages)
SELECT page_id, CASE WHEN p = '' THEN 'dataset' WHEN regexp_matches(p, '^[0-9]') THEN 't_' || lower(p) ELSE lower(p) END AS name
FROM s
""")
def sanitized_names(spark, root):
    return table(spark, root, "pages").select("page_id", N.sanitize(F.col("url")).alias("name"))


@query("""
SELECT 'conn_shop.activity' AS from_table, 'userid' AS from_column, 'conn_shop.users' AS to_table, 'id' AS to_column, 0.8::DOUBLE AS confidence
FROM events HAVING COUNT(DISTINCT user_id) > 0
""")
def new_suggestions(spark, root):
    """Name-based suggestions that the relationships found by values do not cover yet, where the column holds the table's name.

    The scores of the others use a sequence matcher, which SQL does not have; tests hold them against brute force.
    """
    tables = shop(spark, root)
    keyed = pin(R.primary_keys(C.describe(spark, tables)))
    known = R.inclusion(tables, R.candidates(keyed))
    owner = F.regexp_replace(F.element_at(F.split("to_table", r"\."), -1), "s+$", "")
    return R.new_suggestions(R.suggest(keyed), known).filter(F.col("from_column").contains(owner))


@query(f"""
SELECT "from", from_column, "to", to_column, confidence, 'statistical' AS method
FROM ({_inclusion_sql(SHOP_KEYS, prefix="conn_shop.")})
UNION ALL
SELECT 'conn_shop.users', 'id', 'conn_shop.activity', 'userid', 0.4::DOUBLE + 0.4::DOUBLE, 'inferred_constraint'
FROM events HAVING COUNT(*) > 0
""")
def appended_relationships(spark, root):
    """Relationships found by values, plus the suggestions sure enough to be taken in."""
    tables = shop(spark, root)
    keyed = pin(R.primary_keys(C.describe(spark, tables)))
    known = R.inclusion(tables, R.candidates(keyed))
    both = R.append(known, R.suggest(keyed), "inferred_constraint", "_inferred", R.APPEND_CONFIDENCE)
    return both.select("from", "from_column", "to", "to_column", "confidence", "method")


_GONE = {"o_totalprice": "DOUBLE", "o_orderpriority": "VARCHAR", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR"}
_ADDED = {"amount": "DOUBLE", "priority": "VARCHAR", "half": "BIGINT", "initial": "VARCHAR"}


def _resemblance_sql(a, b):
    values = lambda c, t: f"SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL"
    both = f"(SELECT COUNT(*) FROM ({values(a, 'orders')} INTERSECT {values(b, 'later')}))"
    every = f"(SELECT COUNT(*) FROM ({values(a, 'orders')} UNION {values(b, 'later')}))"
    return f"SELECT '{a}' AS old_name, '{b}' AS new_name, {both} / {every} AS r"


@query(
    "WITH later AS (SELECT CASE WHEN o_orderkey % 50 != 0 THEN o_totalprice END AS amount, o_orderpriority AS priority, "
    "o_custkey // 2 + 1000000 AS half, left(o_orderpriority, 1) AS initial FROM orders), pairs AS ("
    + " UNION ALL ".join(_resemblance_sql(a, b) for a, s in _GONE.items() for b, t in _ADDED.items() if s == t)
    + ") SELECT old_name, new_name FROM pairs WHERE r >= 0.8"
)
def renamed_columns(spark, root):
    """Columns that a new version holds under other names, told by their values; one lost a fiftieth of them, two are new."""
    orders = table(spark, root, "orders")
    later = orders.select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("amount"),
        F.col("o_orderpriority").alias("priority"), F.expr("o_custkey div 2 + 1000000").alias("half"),
        F.substring("o_orderpriority", 1, 1).alias("initial"),
    )
    kept = pin(DR.column_values(orders))
    return DR.renamed(kept, pin(DR.column_values(later))).select("old_name", "new_name")
