"""The column catalog: one row per column of every known table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.types import family, sql_name
from siltstone.session import small_frame

CATALOG = (
    "table_schema string, table_name string, model string, column_name string, "
    "ordinal_position int, data_type string, family string, column_count int"
)

# Application tables that are not business data, and the name patterns that mark
# loader, staging and source schemas.
INTERNAL_TABLES = [
    "otps",
    "db_connections",
    "dashboards",
    "sync_configs",
    "sync_history",
    "query_history",
    "mdl_versions",
    "alembic_version",
    "auth_schema_migrations",
    "realtime_schema_migrations",
    "storage_buckets",
    "storage_migrations",
    "extensions_pg_stat_statements",
    "extensions_pg_stat_statements_info",
]
INTERNAL_PREFIXES = [
    "alembic_",
    "sync_",
    "query_",
    "mdl_",
    "auth_",
    "realtime_",
    "extensions_",
    "storage_",
    "_dlt_",
]
SIGNATURE_TABLES = [
    "db_connections",
    "sync_configs",
    "sync_history",
    "query_history",
    "mdl_versions",
    "dashboards",
    "otps",
]
LOADER_TABLE = "_dlt_%"
STAGING = "%_staging"
SOURCE_SCHEMA = "conn_%"


def split_name(model: str) -> tuple[str, str]:
    """``schema.table`` at the first dot; names without a schema belong to ``main``."""
    schema, dot, name = model.partition(".")
    return (schema, name) if dot else ("main", model)


def describe(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog of the given tables from their schemas alone; no row is read."""
    rows = []
    for model, df in tables.items():
        schema, name = split_name(model)
        fields = df.schema.fields
        rows += [
            (schema, name, model, f.name, i, sql_name(f.dataType), family(f.dataType), len(fields))
            for i, f in enumerate(fields, 1)
        ]
    return small_frame(spark, rows, CATALOG)


def discover(catalog: DataFrame, schemas: list[str] | None = None) -> DataFrame:
    """Business tables of a catalog, each column once.

    Drops loader, staging and application tables, and a whole schema that holds two or more of
    the tables typical of an application database.
    """
    schema, name = F.col("table_schema"), F.col("table_name")
    if schemas is None:
        wanted = ((schema == "main") | schema.like(SOURCE_SCHEMA)) & ~schema.like(STAGING)
    else:
        wanted = schema.isin([s for s in schemas if s and s.replace("_", "").isalnum() and s.isascii()])
    tables = catalog.filter(wanted & ~name.like(LOADER_TABLE) & ~name.like(STAGING))
    application = (
        tables.filter(F.lower(name).isin(SIGNATURE_TABLES))
        .groupBy("table_schema")
        .agg(F.count_distinct(F.lower(name)).alias("_n"))
        .filter("_n >= 2")
        .select("table_schema")
    )
    return (
        tables.filter(~schema.endswith("_staging") & ~_internal(name))
        .join(application, "table_schema", "left_anti")
        .dropDuplicates(["table_schema", "table_name", "column_name"])
        .select(*catalog.columns)
    )


def _internal(name: Column) -> Column:
    low = F.lower(name)
    listed = low.isin(INTERNAL_TABLES)
    for prefix in INTERNAL_PREFIXES:
        listed = listed | low.startswith(prefix)
    return listed


def sources(catalog: DataFrame) -> DataFrame:
    """Sources with their sorted table names and table count."""
    return catalog.groupBy("table_schema").agg(
        F.array_sort(F.collect_set("table_name")).alias("tables"),
        F.count_distinct("table_name").alias("table_count"),
        (F.col("table_schema") == "main").alias("is_main"),
    )


def ddl(catalog: DataFrame) -> DataFrame:
    """``CREATE TABLE`` text per table: names and types only, never row data."""
    column = F.concat(F.lit("    "), "column_name", F.lit(" "), "data_type")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", column.alias("text"))))
    body = F.array_join(F.transform(ordered, lambda c: c["text"]), ",\n")
    return (
        catalog.groupBy("model")
        .agg(body.alias("_body"))
        .select("model", F.concat(F.lit("CREATE TABLE "), "model", F.lit(" (\n"), "_body", F.lit("\n);")).alias("ddl"))
    )
