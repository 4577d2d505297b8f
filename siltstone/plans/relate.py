"""Primary keys and relationships between tables, from names, constraints and values.

Everything but ``inclusion`` works on metadata: one row per column or per pair of names. Pairs of
names are always found by equality joins on shared pieces of a name, never by pairing everything
with everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import names as N
from siltstone.functions.types import compatible
from siltstone.operators.profile import UNIQUE_SHARE, count_exactly, presence, unique_columns
from siltstone.session import pin, small_frame, union_all

RELATIONSHIP = [
    "name",
    "from",
    "from_column",
    "to",
    "to_column",
    "join_type",
    "condition",
    "confidence",
    "method",
    "cross_schema",
    "pk_data_type",
    "fk_data_type",
    "cast_applied",
]

# Thresholds and confidences of the discovery passes.
CANDIDATE_SIMILARITY = 70
NAMING_SIMILARITY = 75
MIN_INCLUSION = 0.50
MIN_MATCHES = 3
NAMING_CONFIDENCE = 0.85
NAMING_CONFIDENCE_CAST = 0.80
MODEL_CONFIDENCE = 0.70
HIGH_CONFIDENCE = 0.90
APPEND_CONFIDENCE = 0.6
SUGGEST_CONFIDENCE = 0.3
SUGGEST_PATTERNS = [r"^(.+)_id$", r"^(.+)id$", r"^fk_(.+)$", r"^(.+)_fk$", r"^id_(.+)$"]
SUGGEST_TYPES = "INTEGER|BIGINT|INT|VARCHAR|TEXT|UUID"


@dataclass(frozen=True)
class KeyNaming:
    """How key columns are named; group 1 of the pattern is the name of the table they refer to.

    With ``own_stem`` a primary key is a key column that names its own table and holds unique
    values, instead of one called ``id``, ``uuid`` or ``<singular table>_id``.
    """

    pattern: str = r"^(.*)_(?:id|key|uuid)$"
    own_stem: bool = False


PREFIXED_KEYS = KeyNaming(r"^(?:[a-z]{1,2}_)?(.+?)_?(?:key|id)$", own_stem=True)


# ── primary keys ─────────────────────────────────────────────────────────────


def primary_keys(catalog: DataFrame, naming: KeyNaming = KeyNaming(), unique: DataFrame | None = None) -> DataFrame:
    """Add ``is_primary`` to a catalog.

    ``unique`` holds the (model, column_name) pairs profiling found unique; it is required where
    only the values can tell a key from a reference.
    """
    name, table = F.col("column_name"), F.col("table_name")
    if not naming.own_stem:
        by_name = name.isin("id", "uuid") | (F.lower(name) == F.concat(N.singular(table), F.lit("_id")))
        return catalog.withColumn("is_primary", by_name)
    if unique is None:
        raise ValueError("this naming needs the unique columns of a profile")
    stem = F.lower(F.regexp_extract(name, naming.pattern, 1))
    own = (stem != "") & (F.lower(table).contains(stem) | stem.contains(F.lower(table)))
    confirmed = unique.select(
        F.col("model").alias("_m"), F.col("column_name").alias("_c"), F.lit(True).alias("_unique")
    )
    return (
        catalog.join(confirmed, (F.col("model") == F.col("_m")) & (name == F.col("_c")), "left")
        .withColumn("is_primary", own & F.coalesce("_unique", F.lit(False)))
        .drop("_m", "_c", "_unique")
    )


def suggested_keys(catalog: DataFrame) -> DataFrame:
    """One key per model: ``id``, else the first column named after the table.

    The table's name may stand in full or without a prefix before the first ``_``, each with or
    without its last ``s``.
    """
    base = F.lower("table_name")
    bare = F.when(base.contains("_"), F.regexp_replace(base, "^[^_]*_", "")).otherwise(base)
    short = F.regexp_replace(base, "s$", "")
    bare_short = F.regexp_replace(bare, "s$", "")
    named = F.concat_ws("|", base, short, bare, bare_short)
    low = F.lower("column_name")
    rank = F.when(low == "id", 0).when(
        F.array_contains(F.transform(F.split(named, r"\|"), lambda n: F.concat(n, F.lit("_id"))), low), 1
    )
    return (
        catalog.withColumn("_rank", rank)
        .filter("_rank IS NOT NULL")
        .groupBy("model")
        .agg(F.min_by(F.col("column_name"), F.struct("_rank", "ordinal_position")).alias("column_name"))
    )


# ── join conditions ──────────────────────────────────────────────────────────


def join_condition(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> Column:
    """Equality of two columns, compared where their families differ as the text by which inclusion measures them."""
    from siltstone.functions.types import family

    a, b = family(left_type), family(right_type)
    if a == b or {a, b} <= {"integer", "numeric"}:
        return left == right

    def text(c: Column, dt: T.DataType) -> Column:
        if not isinstance(dt, (T.FractionalType, T.DecimalType)):
            return c.cast("string")
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))

    return text(left, left_type) == text(right, right_type)


def _quoted(model: Column, column: Column) -> Column:
    parts = F.array_join(F.transform(F.split(model, r"\.", 2), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ".")
    return F.concat(parts, F.lit(".`"), column, F.lit("`"))


def _text_of(side: Column, family: Column) -> Column:
    """The SQL by which a column's values become the texts that inclusion compares: whole numbers without a fraction."""
    plain = F.concat(F.lit("CAST("), side, F.lit(" AS STRING)"))
    whole = F.concat(
        F.lit("CASE WHEN "), side, F.lit(" = floor("), side, F.lit(") AND abs("), side, F.lit(") < 1e18 THEN CAST(CAST("),
        side, F.lit(" AS DECIMAL(38,0)) AS STRING) ELSE "), plain, F.lit(" END"),
    )
    return F.when(family == "numeric", whole).otherwise(plain)


def _relationships(pairs: DataFrame, suffix: str, method: str, confidence: Column, *extra: str) -> DataFrame:
    """Relationship rows from pairs that carry pk_* and fk_* columns."""
    same = compatible(F.col("pk_family"), F.col("fk_family"))
    pk, fk = _quoted(F.col("pk_model"), F.col("pk_column")), _quoted(F.col("fk_model"), F.col("fk_column"))
    as_text = [_text_of(pk, F.col("pk_family")), _text_of(fk, F.col("fk_family"))]
    condition = F.when(same, F.concat(pk, F.lit(" = "), fk)).otherwise(F.concat(as_text[0], F.lit(" = "), as_text[1]))
    name = F.concat("fk_model", F.lit("_"), "fk_column", F.lit("__"), "pk_model", F.lit("_"), "pk_column", F.lit(suffix))
    return pairs.withColumn("cast_applied", ~same).select(
        name.alias("name"),
        F.col("pk_model").alias("from"),
        F.col("pk_column").alias("from_column"),
        F.col("fk_model").alias("to"),
        F.col("fk_column").alias("to_column"),
        F.lit("one_to_many").alias("join_type"),
        condition.alias("condition"),
        confidence.cast("double").alias("confidence"),
        F.lit(method).alias("method"),
        (F.col("pk_schema") != F.col("fk_schema")).alias("cross_schema"),
        F.col("pk_type").alias("pk_data_type"),
        F.col("fk_type").alias("fk_data_type"),
        "cast_applied",
        *extra,
    )


def _side(catalog: DataFrame, side: str, *extra: Column) -> DataFrame:
    return catalog.select(
        F.col("model").alias(f"{side}_model"),
        F.col("table_schema").alias(f"{side}_schema"),
        F.col("table_name").alias(f"{side}_table"),
        F.col("column_name").alias(f"{side}_column"),
        F.col("data_type").alias(f"{side}_type"),
        F.col("family").alias(f"{side}_family"),
        *extra,
    )


# ── candidates and inclusion of values ───────────────────────────────────────


def candidates(keyed: DataFrame, naming: KeyNaming = KeyNaming(), cross_schema: bool = False) -> DataFrame:
    """Pairs of a key-like column and another table's primary key whose names go together.

    Names go together when a number form of one is contained in a number form of the other, or
    when their indel ratio is above 70. Pairs stay within one schema unless ``cross_schema``.
    """
    block = F.lit("*") if cross_schema else F.col("table_schema")
    stem = F.lower(F.regexp_extract("column_name", naming.pattern, 1))
    fks = _side(keyed, "fk", block.alias("block"), stem.alias("stem")).filter("stem != ''")
    pks = _side(
        keyed.filter(F.col("is_primary") | (F.col("column_name") == "id")),
        "pk",
        block.alias("block"),
        F.lower("table_name").alias("owner"),
    )

    stems = fks.select("block", "stem").distinct()
    owners = pks.select("block", "owner").distinct()
    matched = _contained(stems, owners).unionByName(_similar(stems, owners)).distinct()
    return (
        fks.join(matched, ["block", "stem"])
        .join(pks, ["block", "owner"])
        .filter(F.col("fk_model") != F.col("pk_model"))
        .drop("block", "stem", "owner")
    )


def _forms(df: DataFrame, name: str, form: str) -> DataFrame:
    return df.withColumn(form, F.explode(N.variations(F.col(name)))).filter(F.col(form) != "")


def _contained(stems: DataFrame, owners: DataFrame) -> DataFrame:
    s, o = _forms(stems, "stem", "form"), _forms(owners, "owner", "form")
    inside = s.join(o.withColumn("form", F.explode(N.substrings(F.col("form")))), ["block", "form"])
    around = o.join(s.withColumn("form", F.explode(N.substrings(F.col("form")))), ["block", "form"])
    return inside.select("block", "stem", "owner").unionByName(around.select("block", "stem", "owner"))


def _similar(stems: DataFrame, owners: DataFrame) -> DataFrame:
    forms = _forms(stems, "stem", "form")
    pairs = resembling(forms, owners, "form", "owner", ["block"], CANDIDATE_SIMILARITY / 100)
    alike = pairs.filter(N.indel_similarity("form", "owner") > CANDIDATE_SIMILARITY)
    return forms.join(alike, ["block", "form"]).select("block", "stem", "owner")


def resembling(left: DataFrame, right: DataFrame, a: str, b: str, within: list[str], ratio: float) -> DataFrame:
    """Distinct name pairs of equal ``within`` that may reach a ratio (0 to 1); none that does is missing.

    A similarity join by prefixes: names meet on pairs of their rarest letters only, and whoever meets must have letters enough
    in common. What is left is for the exact ratio to decide.
    """

    def keyed(df: DataFrame, name: str, letters: str) -> DataFrame:
        found = df.select(*within, name).distinct().withColumn(letters, N.letters(F.col(name)))
        return found.withColumn("_key", F.explode(N.letter_pairs(F.col(letters), ratio)))

    met = keyed(left, a, "_a").join(keyed(right, b, "_b"), [*within, "_key"])
    # A pair that meets on several keys is tested once.
    pairs = met.groupBy(*within, a, b).agg(F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    return pairs.filter(N.may_resemble(F.col("_a"), F.col("_b"), ratio)).drop("_a", "_b")


_WORD = 62


@dataclass(frozen=True)
class KeyValues:
    """How many distinct values occur in which set of columns; columns go by number."""

    ids: dict[tuple[str, str], int]
    sets: DataFrame

    def cardinality(self) -> DataFrame:
        """(model, column_name, cardinality): exact distinct counts of the measured columns."""
        per_id = self.sets.groupBy("id").agg(F.sum("n").alias("cardinality"))
        numbered = small_frame(
            self.sets.sparkSession, [(m, c, i) for (m, c), i in self.ids.items()], "model string, column_name string, id int"
        )
        return numbered.join(per_id, "id", "left").select(
            "model", "column_name", F.coalesce("cardinality", F.lit(0)).alias("cardinality")
        )


def key_columns(tables: dict[str, DataFrame], naming: KeyNaming = KeyNaming()) -> list[tuple[str, str]]:
    """Columns whose names make them keys or references."""
    named = re.compile(f"{naming.pattern}|^(?:id|uuid)$")
    return [(m, c) for m, df in sorted(tables.items()) for c in df.columns if named.search(c)]


def measure(
    tables: dict[str, DataFrame], columns: list[tuple[str, str]], sample: float | None = None, keep_at: str | None = None
) -> KeyValues:
    """Which distinct values the key columns share, all columns of all tables in one job.

    Every table is read once with its key columns only. Each value becomes a fixed-width digest
    and one bit per column, and a single aggregation by value ORs the bits. It combines before the
    shuffle, so a value that fills a third of a column costs one row per task. What is left is one
    count per combination of columns.

    Numbers are compared by value (1 and 1.0 are the same key), everything else as text; 96 bits of
    digest tell values apart. ``sample`` keeps a hash share of the values, the same in every
    column. With ``keep_at`` the counts are written there and read back, for several uses.
    """
    ids = {key: i for i, key in enumerate(columns)}
    words = -(-len(columns) // _WORD)
    melted = []
    for model in sorted({m for m, _ in columns}):
        df = tables[model]
        cells = []
        for (m, c), i in ids.items():
            if m == model:
                bits = [f"{1 << i % _WORD if w == i // _WORD else 0}L AS w{w}" for w in range(words)]
                cells.append(f"struct({_key_text(c, df.schema[c].dataType)} AS v, {', '.join(bits)})")
        melted.append(df.selectExpr(f"inline(array({', '.join(cells)}))"))
    masks = [f"w{w}" for w in range(words)]
    values = union_all(melted).filter("v IS NOT NULL").select(
        F.xxhash64("v").alias("h"), F.hash("v").alias("g"), *masks
    )
    if sample is not None:
        values = values.filter(F.pmod("h", F.lit(10_000)) < int(sample * 10_000))
    by_value = values.groupBy("h", "g").agg(*[F.bit_or(w).alias(w) for w in masks])
    combos = by_value.groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
    if keep_at:
        combos.write.mode("overwrite").parquet(keep_at)
        combos = combos.sparkSession.read.schema(combos.schema).parquet(keep_at)
    bits = ", ".join(f"IF(getbit(w{i // _WORD}, {i % _WORD}) = 1, {i}, NULL)" for i in ids.values())
    present = combos.selectExpr("n", f"array_compact(array({bits})) AS present")
    return KeyValues(ids, present.withColumn("id", F.explode("present")))


def unique_keys(tables: dict[str, DataFrame], measured: KeyValues) -> DataFrame:
    """(model, column_name) of the measured columns that hold a value of their own in every row."""
    columns: dict[str, list[str]] = {}
    for model, name in measured.ids:
        columns.setdefault(model, []).append(name)
    present = presence({m: tables[m].select(*[F.col(f"`{c}`") for c in names]) for m, names in columns.items()})
    found = unique_columns(present.join(measured.cardinality(), ["model", "column_name"]))
    return found.select("model", "column_name")


#: log2 of the entries of a key column's sketch: sets of half as many values and fewer are kept whole.
SKETCH_BITS = 14


def sketches(tables: dict[str, DataFrame], columns: list[tuple[str, str]], keep_at: str | None = None) -> DataFrame:
    """A theta sketch of the values of each key column: (model, column_name, rows, present, sketch, distinct, whole).

    One aggregation per table; a task hands on its sketches, never values. ``whole`` says that the sketch holds all of
    them, so that counts taken from it are exact. Values are compared as by ``measure``.
    """
    parts = []
    for model in sorted({m for m, _ in columns}):
        df = tables[model]
        names = [c for m, c in columns if m == model]
        cells = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.col(f"`{c}`")).alias("present"),
                F.expr(f"theta_sketch_agg({_key_text(c, df.schema[c].dataType)}, {SKETCH_BITS})").alias("sketch"),
            )
            for c in names
        ]
        one = df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
        all_of = F.array(*[F.col(f"c{i}") for i in range(len(cells))])
        parts.append(one.select(F.lit(model).alias("model"), "rows", F.inline(all_of)))
    found = union_all(parts).withColumn("distinct", F.coalesce(F.theta_sketch_estimate("sketch"), F.lit(0)))
    found = found.withColumn("whole", F.col("distinct") <= 1 << (SKETCH_BITS - 1))
    if keep_at:
        found.write.mode("overwrite").parquet(keep_at)
        found = found.sparkSession.read.schema(found.schema).parquet(keep_at)
    return found


def unique_by_sketch(tables: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """(model, column_name) of unique sketched columns; only those that a sketch cannot decide are counted."""
    full = found.filter("present = rows AND rows > 0").select("model", "column_name", "rows", "distinct", "whole").collect()
    error = 5 / 2 ** (SKETCH_BITS / 2)
    sure = [r for r in full if r["whole"]]
    near = [r for r in full if not r["whole"] and r["distinct"] >= UNIQUE_SHARE * r["rows"] * (1 - error)]
    spark = found.sparkSession
    schema = "model string, column_name string, rows bigint, cardinality bigint"
    decided = small_frame(spark, [(r["model"], r["column_name"], r["rows"], r["distinct"]) for r in sure], schema)
    if near:
        listed = small_frame(spark, [(r["model"], r["column_name"], r["rows"]) for r in near], "model string, column_name string, rows bigint")
        counted = count_exactly(tables, [(r["model"], r["column_name"]) for r in near])
        decided = decided.unionByName(listed.join(counted, ["model", "column_name"]))
    return decided.filter(F.col("cardinality") >= UNIQUE_SHARE * F.col("rows")).select("model", "column_name")


def screen(
    pairs: DataFrame, found: DataFrame, min_inclusion: float = MIN_INCLUSION, min_matches: int = MIN_MATCHES
) -> DataFrame:
    """The pairs with (total_count, match_count, whole) by their columns' sketches, without those that surely miss the limits.

    Where both sketches are whole the counts are exact. Else a pair goes only if the upper bound of its matches, five standard
    errors above the estimate, is below the limits.
    """
    side = lambda x: found.select(
        F.col("model").alias(f"{x}_model"), F.col("column_name").alias(f"{x}_column"), F.col("sketch").alias(f"_{x}"),
        F.col("distinct").alias(f"_{x}_n"), F.col("whole").alias(f"_{x}_whole"),
    )
    both = pairs.join(side("fk"), ["fk_model", "fk_column"]).join(side("pk"), ["pk_model", "pk_column"])
    # NULL where a column holds no value.
    match = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("_fk", "_pk")), F.lit(0))
    both = both.withColumn("total_count", F.col("_fk_n")).withColumn("match_count", match).withColumn("whole", F.col("_fk_whole") & F.col("_pk_whole"))
    share = F.least(F.lit(1.0), (1 << SKETCH_BITS) / F.greatest("_fk_n", "_pk_n", F.lit(1)))
    seen = F.col("match_count") * share
    most = F.when(F.col("whole"), F.col("match_count")).otherwise((seen + 5 * F.sqrt(seen + 1) + 12) / share)
    low = F.when(F.col("whole"), F.col("total_count")).otherwise(F.col("total_count") * (1 - 5 / 2 ** (SKETCH_BITS / 2)))
    return both.filter((most >= min_inclusion * low) & (most >= min_matches)).drop("_fk", "_pk", "_fk_n", "_pk_n", "_fk_whole", "_pk_whole")


def inclusion(
    tables: dict[str, DataFrame],
    pairs: DataFrame,
    sample: float | None = None,
    keep_all: bool = False,
    measured: KeyValues | None = None,
    min_inclusion: float = MIN_INCLUSION,
    min_matches: int = MIN_MATCHES,
    sketched: DataFrame | None = None,
) -> DataFrame:
    """Relationships whose distinct reference values are found among the key's values.

    Kept are pairs with at least ``min_inclusion`` of the values and ``min_matches`` of them found;
    ``keep_all`` returns every pair with its counts. ``measured`` is reused if it covers the pairs' columns. With the
    columns' sketches (``sketched``) only the values of pairs that these cannot decide are measured; the result is the same.
    """
    pairs = pin(pairs)
    if sketched is not None and not keep_all and sample is None:
        names = pairs.columns
        kept = pin(screen(pairs, sketched, min_inclusion, min_matches))
        decided = _scored(kept.filter("whole").drop("whole"), keep_all, min_inclusion, min_matches)
        open_ = kept.filter("NOT whole").select(names)
        if open_.isEmpty():
            return decided
        return decided.unionByName(inclusion(tables, open_, min_inclusion=min_inclusion, min_matches=min_matches))
    listed = pairs.select("fk_model", "fk_column", "pk_model", "pk_column").collect()
    columns = sorted({(r[0], r[1]) for r in listed} | {(r[2], r[3]) for r in listed})
    if not columns:
        none = F.lit(0).cast("long")
        return _scored(pairs.withColumn("total_count", none).withColumn("match_count", none), keep_all, min_inclusion, min_matches)
    if measured is None or not set(columns) <= measured.ids.keys():
        measured = measure(tables, columns, sample)
    ids = measured.ids
    key = ["fk_model", "fk_column", "pk_model", "pk_column"]
    coded = small_frame(
        pairs.sparkSession,
        sorted({(*r, ids[r[0], r[1]], ids[r[2], r[3]]) for r in map(tuple, listed)}),
        "fk_model string, fk_column string, pk_model string, pk_column string, id int, pk_id int",
    )
    found = F.sum(F.when(F.array_contains("present", F.col("pk_id")), F.col("n")).otherwise(0))
    counted = coded.join(measured.sets, "id").groupBy(*key).agg(F.sum("n").alias("total_count"), found.alias("match_count"))
    counted = pairs.join(counted, key, "left").fillna(0, ["total_count", "match_count"])
    return _scored(counted, keep_all, min_inclusion, min_matches)


def _scored(measured: DataFrame, keep_all: bool, min_inclusion: float, min_matches: int) -> DataFrame:
    score = F.col("match_count") / F.nullif("total_count", F.lit(0))
    measured = measured.withColumn("_score", score).withColumn("value_overlap", F.round("_score", 2))
    if not keep_all:
        measured = measured.filter((F.col("_score") >= min_inclusion) & (F.col("match_count") >= min_matches))
    base = F.lit(0.75) + (F.col("_score") - 0.50) * 0.4
    across = F.col("pk_schema") != F.col("fk_schema")
    confidence = F.round(F.when(across, F.least(base + 0.05, F.lit(0.98))).otherwise(base), 2)
    return _relationships(measured, "_stat", "statistical", confidence, "value_overlap", "match_count", "total_count")


def _key_text(name: str, dt: T.DataType) -> str:
    c = "`" + name.replace("`", "``") + "`"
    if isinstance(dt, (T.FractionalType, T.DecimalType)):
        whole = f"{c} = floor({c}) AND abs({c}) < 1e18"
        return f"CASE WHEN {whole} THEN CAST(CAST({c} AS DECIMAL(38,0)) AS STRING) ELSE CAST({c} AS STRING) END"
    return f"CAST({c} AS STRING)"


# ── relationships by name ────────────────────────────────────────────────────


def by_name(keyed: DataFrame, cross_schema: bool = False) -> DataFrame:
    """Relationships from names alone: a number form of the table, else the most similar table.

    Only a column without any matching table falls back to similarity. The target's key is its
    first primary key column; a matched table without one gives no relationship.
    """
    block = F.lit("*") if cross_schema else F.col("table_schema")
    stem = F.regexp_extract("column_name", r"^(.+)(?:_id|_key|_uuid|Id)$", 1)
    fks = (
        keyed.withColumn("stem", F.lower(stem))
        .filter("stem != ''")
        .withColumn("block", block)
        .select(
            "block", "stem", F.col("model").alias("fk_model"), F.col("table_schema").alias("fk_schema"),
            F.col("column_name").alias("fk_column"), F.col("data_type").alias("fk_type"), F.col("family").alias("fk_family"),
        )
    )
    tables = keyed.withColumn("block", block).groupBy("block", "model", "table_schema", "table_name").agg(
        F.min_by(
            F.struct("column_name", "data_type", "family"),
            F.when(F.col("is_primary") | (F.col("column_name") == "id"), F.col("ordinal_position")),
        ).alias("_key"),
        F.max(F.col("is_primary") | (F.col("column_name") == "id")).alias("_has_key"),
    )
    targets = tables.select(
        "block", F.col("model").alias("pk_model"), F.col("table_schema").alias("pk_schema"),
        F.lower("table_name").alias("owner"), "_has_key", F.col("_key.column_name").alias("pk_column"),
        F.col("_key.data_type").alias("pk_type"), F.col("_key.family").alias("pk_family"),
    )
    fk_key = ["fk_model", "fk_column"]

    s = fks.select("block", "stem").distinct().select("block", "stem", F.posexplode(N.variations(F.col("stem"))).alias("rank", "form"))
    o = _forms(targets.select("block", "owner").distinct(), "owner", "form")
    name_pairs = s.join(o, ["block", "form"]).groupBy("block", "stem", "owner").agg(F.min("rank").alias("rank"))
    matched = (
        fks.join(name_pairs, ["block", "stem"])
        .join(targets, ["block", "owner"])
        .filter(F.col("fk_model") != F.col("pk_model"))
    )
    nearest = Window.partitionBy(*fk_key).orderBy(
        (F.col("pk_schema") == F.col("fk_schema")).desc(), "rank", "pk_model"
    )
    best = matched.withColumn("_r", F.row_number().over(nearest)).filter("_r = 1")
    compat = compatible(F.col("pk_family"), F.col("fk_family"))
    weight = F.when(compat, NAMING_CONFIDENCE).otherwise(NAMING_CONFIDENCE_CAST)
    named = _relationships(best.filter("_has_key"), "_naming", "naming", weight)

    left = fks.join(matched.select(*fk_key).distinct(), fk_key, "left_anti")
    scored = (
        resembling(
            left.select("block", "stem").distinct(), targets.select("block", "owner").distinct(),
            "stem", "owner", ["block"], NAMING_SIMILARITY / 100,
        )
        .withColumn("score", N.indel_similarity("stem", "owner"))
        .filter(F.col("score") > NAMING_SIMILARITY)
    )
    similar = (
        left.join(scored, ["block", "stem"])
        .join(targets, ["block", "owner"])
        .filter(F.col("fk_model") != F.col("pk_model"))
    )
    closest = Window.partitionBy(*fk_key).orderBy(F.desc("score"), "pk_model")
    pick = similar.withColumn("_r", F.row_number().over(closest)).filter("_r = 1 AND _has_key")
    fuzzy = _relationships(pick, "_fuzzy", "naming_fuzzy", F.round(F.col("score") / 100 * weight, 2))
    return named.unionByName(fuzzy)


# ── relationships from constraints ───────────────────────────────────────────


def source_constraints(table_constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame) -> DataFrame:
    """Foreign keys of a source's information schema: (fk_table, fk_column, pk_table, pk_column).

    ``table_constraints`` has constraint_name, table_schema, constraint_type; the other two have
    constraint_name, table_schema, table_name, column_name. Tables are ``schema.table``.
    """
    on = ["constraint_name", "table_schema"]
    fks = table_constraints.filter(F.col("constraint_type") == "FOREIGN KEY").select(*on)
    used = key_columns.select(*on, F.col("table_name").alias("fk"), F.col("column_name").alias("fk_column"))
    target = referenced.select(*on, F.col("table_name").alias("pk"), F.col("column_name").alias("pk_column"))
    qualified = lambda c: F.concat("table_schema", F.lit("."), c)
    return fks.join(used, on).join(target, on).select(
        qualified("fk").alias("fk_table"), "fk_column", qualified("pk").alias("pk_table"), "pk_column"
    )


def by_constraint(catalog: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Relationships (confidence 1.0) for declared foreign keys between known tables."""
    name = lambda side: F.when(
        F.col(f"{side}_table").startswith("main."), F.substring(F.col(f"{side}_table"), F.lit(6), F.length(f"{side}_table"))
    ).otherwise(F.col(f"{side}_table"))
    declared = foreign_keys.select(
        name("fk").alias("fk_model"), "fk_column", name("pk").alias("pk_model"), "pk_column"
    )
    pairs = declared.join(_side(catalog, "fk"), ["fk_model", "fk_column"]).join(
        _side(catalog, "pk"), ["pk_model", "pk_column"]
    )
    return _relationships(pairs, "_fk", "constraint", F.lit(1.0))


# ── suggestions ──────────────────────────────────────────────────────────────


def suggest(catalog: DataFrame, min_confidence: float = SUGGEST_CONFIDENCE) -> DataFrame:
    """Possible references by a name score from 0 to 1: (from_table, from_column, to_table, to_column).

    0.4 if the column contains the table's name (else 0.2 times their difflib ratio), 0.4 if the
    name taken from the column is the table's (0.2 if one contains the other), 0.2 for ``_id``
    pointing to ``id``. Below 0.3 nothing is suggested, and only three kinds of pair can get
    there: the table's name in the column, the column's part in the table's name, and ``_id`` to
    ``id`` with a ratio of at least one half. Each kind is found by an equality join, then every
    found pair is scored once per distinct name.
    """
    low = F.lower("column_name")
    extracted = F.coalesce(
        *[F.when(low.rlike(p), F.regexp_extract(low, p, 1)) for p in SUGGEST_PATTERNS]
    )
    fks = catalog.filter(F.upper("data_type").rlike(SUGGEST_TYPES)).select(
        F.col("model").alias("from_table"), F.col("column_name").alias("from_column"), low.alias("fk"), extracted.alias("part")
    ).filter("part IS NOT NULL")
    base = F.lower(F.element_at(F.split("model", r"\."), -1))
    pks = suggested_keys(catalog).select(
        F.col("model").alias("to_table"), F.col("column_name").alias("to_column"), base.alias("base"),
        F.regexp_replace(base, "s+$", "").alias("one"), (F.lower("column_name") == "id").alias("plain"),
    )
    left = fks.select("fk", "part").distinct()
    right = pks.select("base", "one", "plain").distinct()

    piece = lambda df, c: df.withColumn("_p", F.explode(N.substrings(F.col(c))))
    whole = lambda df, c: df.withColumn("_p", F.col(c)).filter("_p != ''")
    joins = [
        piece(left, "fk").join(whole(right, "one"), "_p"),
        whole(left, "part").join(piece(right, "base"), "_p"),
        left.filter(F.col("fk").endswith("_id")).withColumn("_p", F.explode(N.rare_letters("fk"))).join(
            right.filter("plain").withColumn("_p", F.explode(N.rare_letters("one"))), "_p"
        ),
    ]
    found = reduce(DataFrame.unionByName, [j.select("fk", "part", "base", "one", "plain") for j in joins]).distinct()

    has_name = F.col("fk").contains(F.col("base")) | F.col("fk").contains(F.col("one"))
    name_part = F.when(has_name, 0.4).otherwise(N.matching_blocks_similarity("fk", "one") * 0.2)
    same = (F.col("part") == F.col("one")) | (F.col("part") == F.col("base"))
    near = F.col("base").contains(F.col("part")) | F.col("part").contains(F.col("base"))
    extract_part = F.when(same, 0.4).when(near, 0.2).otherwise(0.0)
    convention = F.when(F.col("fk").endswith("_id") & F.col("plain"), 0.2).otherwise(0.0)
    score = F.least(name_part + extract_part + convention, F.lit(1.0))
    scored = found.withColumn("_score", score).filter(F.col("_score") >= min_confidence)
    return (
        fks.join(scored, ["fk", "part"])
        .join(pks, ["base", "one", "plain"])
        .filter(F.col("from_table") != F.col("to_table"))
        .select("from_table", "from_column", "to_table", "to_column", F.round("_score", 2).alias("confidence"))
    )


# ── keeping relationships ────────────────────────────────────────────────────


def _ends() -> tuple[Column, Column]:
    a = F.struct(F.col("from").alias("t"), F.col("from_column").alias("c"))
    b = F.struct(F.col("to").alias("t"), F.col("to_column").alias("c"))
    return F.least(a, b), F.greatest(a, b)


def merge(passes: list[DataFrame]) -> DataFrame:
    """One relationship per pair of columns whatever its direction: the most confident, then the
    one from the earlier pass."""
    tagged = [p.withColumn("_pass", F.lit(i)) for i, p in enumerate(passes)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    low, high = _ends()
    order = Window.partitionBy("_low", "_high").orderBy(F.desc("confidence"), "_pass", "name")
    return (
        every.withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn("_r", F.row_number().over(order))
        .filter("_r = 1")
        .drop("_pass", "_low", "_high", "_r")
    )


def accepted(relationships: DataFrame) -> DataFrame:
    """Relationships confident enough for the model, with their level."""
    return relationships.filter(F.col("confidence") >= MODEL_CONFIDENCE).withColumn(
        "level", F.when(F.col("confidence") >= HIGH_CONFIDENCE, "high").otherwise("medium")
    )


def append(
    relationships: DataFrame, found: DataFrame, method: str, suffix: str, min_confidence: float | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Add found references (from = referring side) that the model does not hold yet.

    Declared ones carry confidence 1.0; inferred ones need ``min_confidence``. Conditions are quoted like those of the
    other passes; with a ``catalog`` columns of different families are compared as the texts by which inclusion measures them.
    """
    rows = found if "confidence" in found.columns else found.withColumn("confidence", F.lit(1.0))
    one, many = _quoted(F.col("to_table"), F.col("to_column")), _quoted(F.col("from_table"), F.col("from_column"))
    condition = F.concat(one, F.lit(" = "), many)
    if catalog is not None:
        family = lambda side: catalog.select(
            F.col("model").alias(f"{side}_table"), F.col("column_name").alias(f"{side}_column"), F.col("family").alias(f"_{side}")
        )
        rows = rows.join(family("from"), ["from_table", "from_column"], "left").join(family("to"), ["to_table", "to_column"], "left")
        as_text = F.concat(_text_of(one, F.col("_to")), F.lit(" = "), _text_of(many, F.col("_from")))
        condition = F.when(F.coalesce(compatible(F.col("_to"), F.col("_from")), F.lit(True)), condition).otherwise(as_text)
    if min_confidence is not None:
        rows = rows.filter(F.col("confidence") >= min_confidence)
    name = F.concat("from_table", F.lit("_"), "from_column", F.lit("__"), "to_table", F.lit("_"), "to_column", F.lit(suffix))
    turned = rows.select(
        name.alias("name"),
        F.col("to_table").alias("from"),
        F.col("to_column").alias("from_column"),
        F.col("from_table").alias("to"),
        F.col("from_column").alias("to_column"),
        F.lit("one_to_many").alias("join_type"),
        condition.alias("condition"),
        F.col("confidence").cast("double").alias("confidence"),
        F.lit(method).alias("method"),
    )
    key = ["from", "from_column", "to", "to_column"]
    fresh = turned.dropDuplicates(key).join(relationships.select(*key), key, "left_anti")
    return relationships.unionByName(fresh, allowMissingColumns=True)


def new_suggestions(suggestions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Suggestions the model holds in neither direction."""
    ends = lambda f, fc, t, tc: (
        F.least(F.struct(F.col(f).alias("t"), F.col(fc).alias("c")), F.struct(F.col(t).alias("t"), F.col(tc).alias("c"))),
        F.greatest(F.struct(F.col(f).alias("t"), F.col(fc).alias("c")), F.struct(F.col(t).alias("t"), F.col(tc).alias("c"))),
    )
    low, high = ends("from", "from_column", "to", "to_column")
    known = relationships.select(low.alias("_low"), high.alias("_high")).distinct()
    low, high = ends("from_table", "from_column", "to_table", "to_column")
    return suggestions.withColumn("_low", low).withColumn("_high", high).join(
        known, ["_low", "_high"], "left_anti"
    ).drop("_low", "_high")


def upsert_suggestions(stored: DataFrame, suggestions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Stored suggestions after a new round.

    New ones start as pending, pending ones take the new confidence, confirmed and rejected ones
    stay as they are, and those already in the model are not added.
    """
    key = ["from_table", "from_column", "to_table", "to_column"]
    fresh = new_suggestions(suggestions, relationships).select(*key, F.col("confidence").alias("_new"))
    pending = F.col("status") == "pending"
    return stored.join(fresh, key, "full").select(
        *key,
        F.when(F.col("status").isNull() | (pending & F.col("_new").isNotNull()), F.col("_new"))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        F.coalesce("status", F.lit("pending")).alias("status"),
    )


def confirm(relationships: DataFrame, stored: DataFrame) -> DataFrame:
    """Model relationships plus the confirmed suggestions it does not hold yet."""
    return append(relationships, stored.filter(F.col("status") == "confirmed"), "confirmed_suggestion", "")


def apply_overrides(relationships: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add user-defined relationships whose name is new; a NULL name is ignored."""
    named = overrides.filter(F.col("name").isNotNull()).dropDuplicates(["name"])
    return relationships.unionByName(
        named.join(relationships.select("name"), "name", "left_anti").select(*overrides.columns),
        allowMissingColumns=True,
    )
