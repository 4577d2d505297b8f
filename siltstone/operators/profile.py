"""Column profiles and unique columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import small_frame, union_all

# Fixed value: distinct values per row of a unique column.
UNIQUE_SHARE = 0.99
_CHUNK = 100
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def summarize(df: DataFrame, model: str, exact: bool = False) -> DataFrame:
    """Per column: rows, distinct values, NULL percentage, smallest and largest value as text.

    One aggregation computes every column (up to 100 per pass), with sketches for distinct counts.
    Nested columns get counts only. See ``summarize_all`` for ``exact``.
    """
    return summarize_all({model: df}, exact)


def summarize_all(tables: dict[str, DataFrame], exact: bool = False) -> DataFrame:
    """Profiles of all tables as one result.

    ``exact`` counts distinct values instead of sketching them. Values are told apart by 96-bit
    digests, so all columns of all tables share one shuffle of fixed-width rows, however long
    their texts are.
    """
    profile = union_all([_sketched(df, model, not exact) for model, df in tables.items()])
    if not exact:
        return profile
    columns = [(m, c) for m, df in tables.items() for c in df.columns]
    return with_cardinality(profile, count_exactly(tables, columns))


def _sketched(df: DataFrame, model: str, distinct: bool = True) -> DataFrame:
    fields = df.schema.fields
    long = union_all([_pass(df, fields[i : i + _CHUNK], i, distinct) for i in range(0, len(fields), _CHUNK)])
    empty = "round((row_count - present) / nullif(row_count, 0) * 100, 2)"
    return long.selectExpr(
        f"{_text(model)} AS model",
        "column_name",
        "ordinal_position",
        "row_count",
        "cardinality",
        f"coalesce({empty}, 0.0D) AS null_percentage",
        "min",
        "max",
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pass(df: DataFrame, fields: list[T.StructField], offset: int, distinct: bool) -> DataFrame:
    aggregates, cells = ["count(1) AS row_count"], []
    for i, f in enumerate(fields):
        c = _quoted(f.name)
        nested = isinstance(f.dataType, _NESTED)
        counted = f"to_json({c})" if isinstance(f.dataType, _NESTED[:3]) else c
        low, high = ("NULL", "NULL") if nested else (f"min({c})", f"max({c})")
        aggregates += [
            f"count({c}) AS n{i}",
            f"approx_count_distinct({counted}) AS d{i}" if distinct else f"first(CAST(NULL AS BIGINT)) AS d{i}",
            f"CAST({low} AS STRING) AS lo{i}",
            f"CAST({high} AS STRING) AS hi{i}",
        ]
        cells.append(
            f"struct({_text(f.name)} AS column_name, {offset + i + 1} AS ordinal_position, n{i} AS present, "
            f"d{i} AS cardinality, lo{i} AS min, hi{i} AS max)"
        )
    return df.selectExpr(*aggregates).selectExpr("row_count", f"inline(array({', '.join(cells)}))")


def presence(tables: dict[str, DataFrame]) -> DataFrame:
    """(model, column_name, row_count, null_percentage): counts only, one pass per table."""
    parts = []
    for model, df in tables.items():
        counts = [f"count({_quoted(c)}) AS n{i}" for i, c in enumerate(df.columns)]
        cells = ", ".join(f"struct({_text(c)} AS column_name, n{i} AS present)" for i, c in enumerate(df.columns))
        counted = df.selectExpr("count(1) AS row_count", *counts)
        parts.append(counted.selectExpr(f"{_text(model)} AS model", "row_count", f"inline(array({cells}))"))
    empty = "IF(row_count = 0, 0.0D, (row_count - present) / row_count * 100) AS null_percentage"
    return union_all(parts).selectExpr("model", "column_name", "row_count", empty)


def count_exactly(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(model, column_name, cardinality) of the given columns, all tables in one job."""
    ids = {key: i for i, key in enumerate(columns)}
    parts = [
        _digests(tables[m], {c: i for (model, c), i in ids.items() if model == m}) for m in sorted({m for m, _ in ids})
    ]
    counted = union_all(parts).distinct().groupBy("_i").agg(F.count(F.lit(1)).alias("_distinct"))
    spark = next(iter(tables.values())).sparkSession
    known = small_frame(spark, [(i, m, c) for (m, c), i in ids.items()], "_i int, model string, column_name string")
    return known.join(counted, "_i", "left").select(
        "model", "column_name", F.coalesce("_distinct", F.lit(0)).alias("cardinality")
    )


def _digests(df: DataFrame, ids: dict[str, int]) -> DataFrame:
    """(column id, 96-bit digest) of the given columns, NULLs left out."""

    def cell(name: str, i: int) -> str:
        c = _quoted(name)
        value = f"to_json({c})" if isinstance(df.schema[name].dataType, _NESTED[:3]) else c
        return f"struct(IF({c} IS NULL, NULL, {i}) AS _i, xxhash64({value}) AS _h, hash({value}) AS _g)"

    cells = ", ".join(cell(name, i) for name, i in ids.items())
    return df.selectExpr(f"inline(array({cells}))").filter("_i IS NOT NULL")


def with_cardinality(profile: DataFrame, exact: DataFrame) -> DataFrame:
    """A profile with its estimates replaced where exact counts (model, column_name, cardinality) are known."""
    known = exact.select("model", "column_name", F.col("cardinality").alias("_exact"))
    joined = profile.join(known, ["model", "column_name"], "left")
    return joined.withColumn("cardinality", F.coalesce("_exact", "cardinality")).drop("_exact")


def mark_unique(profile: DataFrame) -> DataFrame:
    """Add ``is_unique``: rows, no NULLs, and at least 99 % as many distinct values as rows."""
    rows = F.col("row_count")
    full = (rows > 0) & (F.col("null_percentage") == 0)
    return profile.withColumn("is_unique", full & (F.col("cardinality") >= rows * UNIQUE_SHARE))


def verify_unique(tables: dict[str, DataFrame], profile: DataFrame) -> DataFrame:
    """Exact distinct counts (model, column_name, row_count, cardinality) of every column that could be unique.

    Those are all without NULLs, of tables with rows; no estimate decides. All tables are counted in one job,
    and every count is returned, whether it confirms the column or not. Values are told apart by 96-bit digests.
    """
    full = profile.filter((F.col("null_percentage") == 0) & (F.col("row_count") > 0))
    columns = full.select("model", "column_name", "row_count").collect()
    shape = "model string, column_name string, row_count bigint"
    if not columns:
        return small_frame(profile.sparkSession, [], f"{shape}, cardinality bigint")
    exact = count_exactly(tables, [(r.model, r.column_name) for r in columns])
    known = small_frame(profile.sparkSession, [tuple(r) for r in columns], shape)
    return known.join(exact, ["model", "column_name"])


def unique_columns(profile: DataFrame) -> DataFrame:
    return mark_unique(profile).filter("is_unique").select("model", "column_name", "row_count", "cardinality")
