"""The semantic model: classified columns, relationships, computed columns, isolated tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.types import family
from siltstone.operators import catalog as C
from siltstone.operators import profile as P
from siltstone.plans import relate as R
from siltstone.session import pin, small_frame, union_all, work_dir

# Words that decide a column's category and display format.
TEMPORAL_WORDS = [
    "created_at", "updated_at", "deleted_at", "started_at", "ended_at", "created_on", "updated_on",
    "start_time", "end_time", "start_date", "end_date", "timestamp", "deadline",
]
BOOLEAN_PREFIXES = ["is_", "has_", "can_"]
LONG_TEXT_TYPES = ["TEXT", "JSON", "JSONB", "CLOB"]
LONG_TEXT_WORDS = [
    "description", "content", "note", "notes", "bio", "body", "message", "comment", "reason",
]
MEASURE_WORDS = [
    "amount", "price", "cost", "revenue", "total", "sum", "count", "quantity", "qty", "num", "balance",
    "value", "fee", "charge", "score", "rating", "points", "rank", "weight", "size", "length", "width",
    "height", "duration", "minutes", "hours", "days", "participants", "enrolled", "profit", "margin",
    "discount", "tax", "spent", "budget", "salary", "wage", "income", "expense", "debit", "credit",
]
NUMBER_WORDS = ["count", "quantity", "num", "participants", "enrolled"]
CURRENCY_WORDS = [
    "amount", "price", "cost", "revenue", "total", "value", "balance", "fee", "charge", "profit", "salary",
    "wage", "income", "expense", "budget", "spent", "tax", "discount",
]

# Result word, words of the left and right operand, operator.
COMPUTED_HINTS = [
    ("profit", ["revenue", "income", "sales"], ["cost", "expense", "spending"], "-"),
    ("margin", ["revenue", "income", "sales", "price"], ["cost", "expense"], "-"),
    ("net", ["gross", "total", "revenue"], ["deduction", "tax", "discount", "cost"], "-"),
    ("total", ["subtotal", "price", "amount"], ["tax", "fee", "shipping", "charge"], "+"),
    ("balance", ["credit", "deposit", "income"], ["debit", "withdrawal", "expense"], "-"),
]
EXACT_TOLERANCE = 0.01
APPROXIMATE_TOLERANCE = 0.05
MATCH_SHARE = 0.6
MIN_ROWS = 3


def _any_word(name: Column, words: list[str]) -> Column:
    return name.rlike("|".join(words))


def classify(keyed: DataFrame, key_pattern: str = r"_(id|key|uuid)$") -> DataFrame:
    """Add category, aggregation, format and hidden to a catalog; the first rule that fits wins.

    Numbers are recognised by type family, so a decimal with precision and scale can be a measure.
    """
    name, dtype, fam = F.lower("column_name"), F.upper("data_type"), F.col("family")
    boolean = (fam == "boolean") | reduce(lambda a, b: a | b, [name.startswith(p) for p in BOOLEAN_PREFIXES])
    long_text = dtype.isin(LONG_TEXT_TYPES) | ((fam == "string") & _any_word(name, LONG_TEXT_WORDS))
    measure = fam.isin("integer", "numeric") & _any_word(name, MEASURE_WORDS)
    category = (
        F.when(name.startswith("_dlt"), "METADATA")
        .when(F.col("is_primary") | (name == "id"), "IDENTIFIER")
        .when(name.rlike(key_pattern), "FOREIGN_KEY")
        .when(fam == "temporal", "TEMPORAL")
        .when(_any_word(name, TEMPORAL_WORDS), "TEMPORAL")
        .when(boolean, "BOOLEAN")
        .when(long_text, "TEXT_LONG")
        .when(measure, "MEASURE")
        .otherwise("DIMENSION")
    )
    style = F.when(_any_word(name, NUMBER_WORDS), "number").when(_any_word(name, CURRENCY_WORDS), "currency").otherwise("number")
    is_measure = F.col("category") == "MEASURE"
    return (
        keyed.withColumn("category", category)
        .withColumn("aggregation", F.when(is_measure, "sum"))
        .withColumn("format", F.when(is_measure, style))
        .withColumn("hidden", F.col("category") == "METADATA")
    )


def roles(classified: DataFrame) -> DataFrame:
    """Measures, dimensions and temporal columns of each model, in column order."""

    def named(category: str) -> Column:
        hits = F.collect_list(F.when(F.col("category") == category, F.struct("ordinal_position", "column_name")))
        return F.transform(F.array_sort(hits), lambda c: c["column_name"])

    return classified.groupBy("model").agg(
        named("MEASURE").alias("measures"),
        named("DIMENSION").alias("dimensions"),
        named("TEMPORAL").alias("temporal_columns"),
    )


@dataclass(frozen=True)
class Formula:
    result: str
    left: str
    right: str
    operator: str


def hinted_formulas(df: DataFrame, keys: set[str] | None = None) -> list[Formula]:
    """Column triples of a table whose names suggest result = left op right."""
    skip = keys or set()
    numeric = [
        f.name
        for f in df.schema.fields
        if family(f.dataType) in ("integer", "numeric") and f.name not in skip and not f.name.endswith("_id")
    ]
    if len(numeric) < 3:
        return []

    def first(words: list[str], taken: set[str]) -> str | None:
        hits = (c for w in words for c in numeric if w in c.lower() and c not in taken)
        return next(hits, None)

    found = []
    for result_word, left_words, right_words, op in COMPUTED_HINTS:
        result = first([result_word], set())
        left = result and first(left_words, {result})
        right = left and first(right_words, {result, left})
        if right:
            found.append(Formula(result, left, right, op))
    return found


def computed_columns(tables: dict[str, DataFrame], keys: dict[str, set[str]] | None = None) -> DataFrame:
    """Columns that are the sum or difference of two others, tested on every row that has all three.

    All formulas of a table share one aggregation. A formula holds exactly (within 0.01) or
    approximately (within 5 %) when at least 60 % of at least three rows agree.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for model, df in tables.items():
        formulas = hinted_formulas(df, (keys or {}).get(model))
        if not formulas:
            continue
        aggregates = [c for i, f in enumerate(formulas) for c in _agreement(f, i)]
        cells = F.array(
            *[
                F.struct(
                    F.lit(f.result).alias("result_column"),
                    F.lit(f.left).alias("left_column"),
                    F.lit(f.right).alias("right_column"),
                    F.lit(f.operator).alias("operator"),
                    F.col(f"_rows{i}").alias("rows"),
                    F.col(f"_exact{i}").alias("exact_rows"),
                    F.col(f"_near{i}").alias("approximate_rows"),
                )
                for i, f in enumerate(formulas)
            ]
        )
        schema, name = C.split_name(model)
        parts.append(
            df.agg(*aggregates).select(F.explode(cells).alias("c")).select(
                F.lit(schema).alias("table_schema"), F.lit(name).alias("table_name"), "c.*"
            )
        )
    if not parts:
        return small_frame(
            spark, [],
            "table_schema string, table_name string, result_column string, left_column string, right_column string, "
            "operator string, rows bigint, exact_rows bigint, approximate_rows bigint, formula string, "
            "validation string, confidence double",
        )
    tested = union_all(parts)
    rows = F.col("rows")
    validation = F.when(F.col("exact_rows") >= rows * MATCH_SHARE, "exact").when(
        F.col("exact_rows") + F.col("approximate_rows") >= rows * MATCH_SHARE, "approximate"
    )
    return (
        tested.withColumn("formula", F.concat_ws(" ", "left_column", "operator", "right_column"))
        .withColumn("validation", F.when(rows >= MIN_ROWS, validation))
        .filter("validation IS NOT NULL")
        .withColumn("confidence", F.when(F.col("validation") == "exact", 0.85).otherwise(0.70))
    )


def _agreement(f: Formula, i: int) -> list[Column]:
    left, right, result = (F.col(f"`{c}`").cast("double") for c in (f.left, f.right, f.result))
    expected = left - right if f.operator == "-" else left + right
    gap = F.abs(expected - result)
    exact = gap < EXACT_TOLERANCE
    near = ~exact & (result != 0) & (gap < F.abs(result) * APPROXIMATE_TOLERANCE)
    return [
        F.count(gap).alias(f"_rows{i}"),
        F.count(F.when(exact, 1)).alias(f"_exact{i}"),
        F.count(F.when(near, 1)).alias(f"_near{i}"),
    ]


def isolated(catalog: DataFrame, relationships: DataFrame) -> DataFrame:
    """Tables without any relationship."""
    tables = catalog.select("table_schema", "model").distinct().filter(~F.col("model").startswith("_dlt"))
    return tables.join(_connected(relationships), "model", "left_anti")


def isolated_sources(catalog: DataFrame, relationships: DataFrame) -> DataFrame:
    """Schemas none of whose tables has a relationship."""
    tables = catalog.select("table_schema", "model").distinct()
    used = tables.join(_connected(relationships), "model", "left_semi").select("table_schema")
    return tables.select("table_schema").distinct().join(used, "table_schema", "left_anti")


def _connected(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.col("from").alias("model")).union(relationships.select(F.col("to"))).distinct()


class Model:
    """A discovered semantic model.

    Its parts are frames of metadata. Those that need another pass over the tables are computed
    on first use and then kept.
    """

    def __init__(self, tables, catalog, keyed, relationships, naming, profile) -> None:
        self.tables: dict[str, DataFrame] = tables
        self.catalog: DataFrame = catalog
        self.keyed: DataFrame = keyed
        self.relationships: DataFrame = relationships
        self._naming: R.KeyNaming = naming
        self._profile = profile

    @cached_property
    def columns(self) -> DataFrame:
        """Catalog, category and profile of every column."""
        pattern = r"_(id|key|uuid)$" if not self._naming.own_stem else self._naming.pattern
        stats = self._profile().drop("ordinal_position")
        return pin(classify(self.keyed, pattern).join(stats, ["model", "column_name"], "left"))

    @cached_property
    def roles(self) -> DataFrame:
        return roles(self.columns)

    @cached_property
    def computed(self) -> DataFrame:
        keys: dict[str, set[str]] = {}
        for model, name in self.keyed.filter("is_primary").select("model", "column_name").collect():
            keys.setdefault(model, set()).add(name)
        return pin(computed_columns(self.tables, keys))

    @cached_property
    def sources(self) -> DataFrame:
        return C.sources(self.catalog)

    @cached_property
    def isolated_tables(self) -> DataFrame:
        return isolated(self.catalog, self.relationships)

    @cached_property
    def isolated_sources(self) -> DataFrame:
        return isolated_sources(self.catalog, self.relationships)


def generate(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    naming: R.KeyNaming = R.KeyNaming(),
    schemas: list[str] | None = None,
    foreign_keys: DataFrame | None = None,
    overrides: DataFrame | None = None,
    exact_profile: bool = False,
) -> Model:
    """Discover the model of the given tables.

    Table rows are touched by one job over the key columns, for their distinct counts and inclusion
    alike, by one aggregation per table for the profile, by one exact count of the other columns
    that look unique, and by one aggregation for hinted formulas. What they return has one row per
    column or pair and is pinned, so no pass runs twice.
    """
    catalog = pin(C.discover(C.describe(spark, tables), schemas))
    known = {r[0] for r in catalog.select("model").distinct().collect()}
    kept = {m: df for m, df in tables.items() if m in known}
    if not kept:
        raise ValueError("no tables found to build a model from")
    key_columns = R.key_columns(kept, naming)
    measured = R.measure(kept, key_columns, keep_at=work_dir(spark, "key-values")) if key_columns else None

    @cache
    def profile() -> DataFrame:
        found = P.summarize_all(kept, exact_profile)
        found = pin(P.with_cardinality(found, measured.cardinality()) if measured else found)
        if not exact_profile:
            others = found.filter(~F.col("column_name").rlike(f"{naming.pattern}|^(?:id|uuid)$"))
            found = P.with_cardinality(found, P.verify_unique(kept, others))
        return pin(P.mark_unique(found))

    unique = R.unique_keys(kept, measured) if naming.own_stem and measured else None
    keyed = pin(R.primary_keys(catalog, naming, unique))
    passes = [R.inclusion(kept, R.candidates(keyed, naming), measured=measured), R.by_name(keyed)]
    if foreign_keys is not None:
        passes.insert(0, R.by_constraint(keyed, foreign_keys))
    found = R.accepted(R.merge(passes))
    relationships = pin(found if overrides is None else R.apply_overrides(found, overrides))
    return Model(kept, catalog, keyed, relationships, naming, profile)


def document(model: Model) -> str:
    """The model as one JSON document (version 3.0); every column and relationship appears once."""

    def rows(df: DataFrame) -> list[dict]:
        return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]

    by_model: dict[str, list[dict]] = {}
    for c in sorted(rows(model.columns), key=lambda c: (c["model"], c["ordinal_position"])):
        by_model.setdefault(c["model"], []).append(
            {
                "name": c["column_name"],
                "type": c["data_type"],
                "primary_key": c["is_primary"],
                "category": c["category"],
                "aggregation": c.get("aggregation"),
                "format": c.get("format"),
                "hidden": c["hidden"],
                "is_unique": c.get("is_unique"),
                "stats": {k: c.get(k) for k in ("cardinality", "null_percentage", "min", "max")},
            }
        )
    parts = {r["model"]: r for r in rows(model.roles)}
    relationships = sorted(rows(model.relationships), key=lambda r: r["name"])
    return json.dumps(
        {
            "version": "3.0",
            "models": [
                {
                    "name": name,
                    "source": C.split_name(name)[0],
                    "table_name": C.split_name(name)[1],
                    "columns": columns,
                    **{k: parts[name][k] for k in ("measures", "dimensions", "temporal_columns")},
                }
                for name, columns in by_model.items()
            ],
            "relationships": relationships,
            "relationship_suggestions": {
                "high_confidence": [r for r in relationships if r["confidence"] >= R.HIGH_CONFIDENCE],
                "medium_confidence": [r for r in relationships if r["confidence"] < R.HIGH_CONFIDENCE],
            },
            "computed_columns": rows(model.computed),
            "data_sources": {r["table_schema"]: r for r in rows(model.sources)},
            "isolated_tables": sorted(r["model"] for r in rows(model.isolated_tables)),
            "isolated_sources": sorted(r["table_schema"] for r in rows(model.isolated_sources)),
        },
        indent=2,
    )
