from difflib import SequenceMatcher

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import names as N
from siltstone.plans import relate as R
from test_catalog_model import catalog


def test_primary_keys_by_name(spark):
    cat = catalog(spark, [("main", "users", c, "BIGINT") for c in ("id", "uuid", "user_id", "User_ID", "users_id", "x")])
    got = {r.column_name for r in R.primary_keys(cat).filter("is_primary").collect()}
    assert got == {"id", "uuid", "user_id", "User_ID"}


def test_primary_keys_by_own_stem_need_unique_values(spark):
    cat = catalog(spark, [("main", "orders", c, "BIGINT") for c in ("o_orderkey", "o_custkey", "l_orderkey")])
    unique = spark.createDataFrame([("orders", "o_orderkey"), ("orders", "o_custkey")], "model string, column_name string")
    got = R.primary_keys(cat, R.PREFIXED_KEYS, unique).filter("is_primary")
    assert rows(got.select("column_name")) == [("o_orderkey",)]
    with pytest.raises(ValueError):
        R.primary_keys(cat, R.PREFIXED_KEYS)


def test_suggested_keys(spark):
    cat = catalog(
        spark,
        [("s", "a", "x", "INT"), ("s", "a", "ID", "INT"), ("s", "app_users", "user_id", "INT"), ("s", "boxes", "boxe_id", "INT"),
         ("s", "none", "other_id", "INT"), ("s", "plan", "plan_id", "INT")],
    )
    assert rows(R.suggested_keys(cat)) == [("s.a", "ID"), ("s.app_users", "user_id"), ("s.boxes", "boxe_id"), ("s.plan", "plan_id")]


def naive_forms(w):
    """Number forms by the plain rules, for the brute-force comparison below."""
    both = N._BOTH_WAYS

    def one(x):
        if x in both:
            return both[x]
        for end, cut, add in (("ies", 3, "y"), ("ses", 2, ""), ("ches", 2, ""), ("shes", 2, "")):
            if x.endswith(end) and len(x) > len(end) - (end[1:] == "hes"):
                return x[: len(x) - cut] + add
        return x[:-1] if x.endswith("s") and not x.endswith("ss") else x

    def many(x):
        if x in both:
            return both[x]
        if x.endswith("y") and len(x) > 1 and x[-2] not in "aeiou":
            return x[:-1] + "ies"
        return x + ("es" if x.endswith(("s", "sh", "ch", "x", "z")) else "s")

    return {w, one(w), many(w), one(many(w))} - {""}


TABLES = ["users", "user_profiles", "categories", "boxes", "people", "orders", "order_items", "statuses", "ss", "adress", "status"]
KEYS = ["user_id", "usr_id", "category_id", "box_key", "person_id", "child_id", "order_uuid", "item_id", "adres_id", "status_id", "_id", "x_key", "orde_id"]


def test_candidates_equal_brute_force(spark):
    cols = [("main", t, "id", "BIGINT") for t in TABLES] + [("main", "facts", k, "BIGINT") for k in KEYS]
    cols += [("conn_x", "users", "id", "BIGINT")]
    keyed = R.primary_keys(catalog(spark, cols))
    got = {(r.fk_column, r.pk_model) for r in R.candidates(keyed).collect()}
    want = set()
    for k in KEYS:
        stem = k.rsplit("_", 1)[0]
        for t in TABLES:
            f, p = naive_forms(stem) if stem else set(), naive_forms(t)
            inside = any(a in b or b in a for a in f for b in p)
            if inside or any(N.indel_ratio(a, t) > 70 for a in f):
                want.add((k, t))
    assert got == want
    across = {r.pk_model for r in R.candidates(keyed, cross_schema=True).collect()}
    assert "conn_x.users" in across


def naive_score(fk, pk_table, pk_column):
    import re

    base = pk_table.split(".")[-1].lower()
    one, low, score = base.rstrip("s"), fk.lower(), 0.0
    if base in low or one in low:
        score += 0.4
    else:
        score += SequenceMatcher(None, low, one).ratio() * 0.2
    for p in R.SUGGEST_PATTERNS:
        m = re.match(p, low)
        if m:
            if m.group(1) in (one, base):
                score += 0.4
            elif m.group(1) in base or base in m.group(1):
                score += 0.2
            break
    if low.endswith("_id") and pk_column.lower() == "id":
        score += 0.2
    return min(score, 1.0)


def test_suggestions_equal_brute_force(spark):
    tables = ["users", "accounts", "order_items", "orders", "region", "address", "cats", "prospects"]
    keys = ["user_id", "userId", "fk_user", "user_fk", "id_user", "usr_id", "item_id", "orderid", "paid", "acct_id", "rgn_id", "cat_id", "spect_id", "plain"]
    cols = [("conn_a", t, "id", "BIGINT") for t in tables] + [("conn_a", "facts", k, "VARCHAR") for k in keys]
    cols += [("conn_a", "facts", "blob_id", "BLOB")]
    got = {(r.from_column, r.to_table): r.confidence for r in R.suggest(catalog(spark, cols)).filter("from_table = 'conn_a.facts'").collect()}
    want = {}
    for k in keys[:-1]:
        for t in tables:
            s = naive_score(k, t, "id")
            if s >= 0.3:
                want[k, f"conn_a.{t}"] = pytest.approx(round(s, 2))
    assert got == want


def overlap_tables(spark):
    pk = spark.range(1, 101).select(F.col("id").cast("int").alias("id"))
    values = {
        "all": [(i,) for i in range(1, 101)],
        "half": [(i,) for i in range(51, 151)],
        "less": [(i,) for i in range(52, 152)],
        "two": [(1,), (2,)],
        "nulls": [(None,), (None,)],
        "hot": [(7,)] * 500 + [(8,), (9,), (10,)],
    }
    tables = {f"t_{n}": spark.createDataFrame(v, "pk_id int") for n, v in values.items()}
    tables["t_text"] = spark.createDataFrame([(str(i),) for i in range(1, 11)], "pk_id string")
    tables["t_double"] = spark.createDataFrame([(float(i),) for i in range(1, 11)], "pk_id double")
    return {"pks": pk, **tables}


def pairs(spark, tables):
    from siltstone.operators.catalog import describe

    return R.candidates(R.primary_keys(describe(spark, tables)))


def test_inclusion_scores(spark):
    tables = overlap_tables(spark)
    found = {r.to: r for r in R.inclusion(tables, pairs(spark, tables)).collect()}
    assert set(found) == {"t_all", "t_half", "t_hot", "t_text", "t_double"}
    assert (found["t_all"].confidence, found["t_half"].confidence) == (0.95, 0.75)
    assert (found["t_half"].match_count, found["t_half"].total_count, found["t_half"].value_overlap) == (50, 100, 0.5)
    assert found["t_hot"].total_count == 4
    assert found["t_text"].cast_applied and not found["t_double"].cast_applied
    assert found["t_text"].condition == "CAST(`pks`.`id` AS STRING) = CAST(`t_text`.`pk_id` AS STRING)"
    assert found["t_all"].name == "t_all_pk_id__pks_id_stat"


def test_inclusion_of_all_pairs_equals_pair_by_pair(spark):
    tables = overlap_tables(spark)
    every = pairs(spark, tables)
    together = rows(R.inclusion(tables, every, keep_all=True).select("to", "match_count", "total_count"))
    single = []
    for t in sorted(tables.keys() - {"pks"}):
        one = every.filter(F.col("fk_model") == t)
        single += rows(R.inclusion(tables, one, keep_all=True).select("to", "match_count", "total_count"))
    assert together == sorted(single, key=repr)
    sampled = R.inclusion(tables, every, sample=0.5, keep_all=True).filter("to = 't_all'").first()
    assert 20 < sampled.total_count < 80 and sampled.match_count == sampled.total_count


def test_more_columns_than_bits_in_a_word(spark):
    wide = spark.range(1, 6).select(*[(F.col("id") + 0).alias(f"pk{i}_id") for i in range(70)])
    tables = {"pks": spark.range(1, 6), "wide": wide}
    columns = [("pks", "id")] + [("wide", c) for c in wide.columns]
    measured = R.measure(tables, columns)
    assert {r.cardinality for r in measured.cardinality().collect()} == {5}
    assert len(measured.ids) == 71


def test_measured_counts_are_exact(spark, tmp_path):
    tables = overlap_tables(spark)
    measured = R.measure(tables, [(m, df.columns[0]) for m, df in tables.items()], keep_at=str(tmp_path / "m"))
    got = {r.model: r.cardinality for r in measured.cardinality().collect()}
    assert got == {m: df.dropna().distinct().count() for m, df in tables.items()}


def test_no_candidates(spark):
    tables = {"a": spark.range(2), "b": spark.createDataFrame([(1,)], "zzz_id int")}
    assert R.inclusion(tables, pairs(spark, tables)).count() == 0


def test_relationships_by_name(spark):
    cols = [("main", t, "id", "BIGINT") for t in ("users", "categories", "children", "boxes", "customers")]
    cols += [("main", "nokey", "x", "BIGINT")]
    cols += [("main", "facts", c, "BIGINT") for c in ("user_id", "category_id", "child_id", "box_key", "userId", "custmer_id", "nokey_id", "zq_id")]
    cols += [("main", "facts", "boxes_uuid", "VARCHAR"), ("conn_x", "far", "user_id", "BIGINT")]
    found = {(r.to, r.to_column): r for r in R.by_name(R.primary_keys(catalog(spark, cols))).collect()}
    assert {k[1]: r["from"] for k, r in found.items() if k[0] == "facts"} == {
        "user_id": "users", "category_id": "categories", "child_id": "children", "box_key": "boxes", "userId": "users",
        "custmer_id": "customers", "boxes_uuid": "boxes",
    }
    assert not [k for k in found if k[0] == "conn_x.far"]
    assert found["facts", "user_id"].confidence == 0.85
    assert found["facts", "boxes_uuid"].confidence == 0.80
    fuzzy = found["facts", "custmer_id"]
    score = N.indel_ratio("custmer", "customers")
    assert fuzzy.method == "naming_fuzzy" and fuzzy.confidence == pytest.approx(round(score / 100 * 0.85, 2))


def test_join_condition_casts_across_families(spark):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(1, "1", 1.0)], "a int, b string, c double")
    assert df.filter(R.join_condition(a, T.IntegerType(), b, T.StringType())).count() == 1
    assert df.filter(R.join_condition(a, T.IntegerType(), F.col("c"), T.DoubleType())).count() == 1


def test_source_constraints(spark):
    tc = spark.createDataFrame(
        [("fk1", "public", "FOREIGN KEY"), ("pk1", "public", "PRIMARY KEY"), ("fk1", "other", "FOREIGN KEY")],
        "constraint_name string, table_schema string, constraint_type string",
    )
    shape = "constraint_name string, table_schema string, table_name string, column_name string"
    kcu = spark.createDataFrame([("fk1", "public", "orders", "customer_id"), ("pk1", "public", "orders", "id")], shape)
    ccu = spark.createDataFrame([("fk1", "public", "customers", "id"), ("pk1", "public", "orders", "id")], shape)
    assert rows(R.source_constraints(tc, kcu, ccu)) == [("public.orders", "customer_id", "public.customers", "id")]


def rel(spark, *items):
    return spark.createDataFrame(
        [(n, a, ac, b, bc, c) for n, a, ac, b, bc, c in items],
        "name string, `from` string, from_column string, `to` string, to_column string, confidence double",
    )


def test_merge_keeps_the_most_confident_whatever_the_direction(spark):
    first = rel(spark, ("p1", "a", "id", "b", "a_id", 0.8), ("keep", "a", "id", "c", "a_id", 0.9))
    second = rel(spark, ("p2", "b", "a_id", "a", "id", 0.9), ("lose", "a", "id", "c", "a_id", 0.9), ("low", "x", "id", "y", "x_id", 0.69))
    merged = R.merge([first, second])
    assert rows(merged.select("name")) == [("keep",), ("low",), ("p2",)]
    assert rows(R.merge([merged, merged]).select("name")) == rows(merged.select("name"))
    edge = rel(spark, ("a", "a", "i", "b", "j", 0.69), ("b", "a", "i", "b", "k", 0.70), ("c", "a", "i", "b", "l", 0.90))
    assert rows(R.accepted(edge).select("name", "level")) == [("b", "medium"), ("c", "high")]


def test_append_skips_known_and_unsure(spark):
    model = rel(spark, ("known", "users", "id", "orders", "user_id", 0.9))
    found = spark.createDataFrame(
        [("orders", "user_id", "users", "id", 0.8), ("orders", "x_id", "xs", "id", 0.59), ("orders", "y_id", "ys", "id", 0.6)],
        "from_table string, from_column string, to_table string, to_column string, confidence double",
    )
    both = R.append(model, found, "inferred_constraint", "_inferred", R.APPEND_CONFIDENCE)
    assert rows(both.select("name")) == [("known",), ("orders_y_id__ys_id_inferred",)]
    declared = R.append(model, found.drop("confidence"), "source_constraint", "_srcfk")
    assert declared.filter("method = 'source_constraint' AND confidence = 1.0").count() == 2


def test_suggestions_are_upserted(spark):
    key = "from_table string, from_column string, to_table string, to_column string, confidence double"
    stored = spark.createDataFrame(
        [("a", "x_id", "x", "id", 0.5, "pending"), ("a", "y_id", "y", "id", 0.5, "confirmed"), ("a", "z_id", "z", "id", 0.5, "rejected"), ("a", "old_id", "old", "id", 0.4, "pending")],
        key + ", status string",
    )
    fresh = spark.createDataFrame(
        [("a", c, t, "id", 0.9) for c, t in (("x_id", "x"), ("y_id", "y"), ("z_id", "z"), ("n_id", "n"), ("m_id", "m"))], key
    )
    model = rel(spark, ("m", "a", "m_id", "m", "id", 1.0))
    got = {r.from_column: (r.confidence, r.status) for r in R.upsert_suggestions(stored, fresh, model).collect()}
    assert got == {
        "x_id": (0.9, "pending"), "y_id": (0.5, "confirmed"), "z_id": (0.5, "rejected"), "old_id": (0.4, "pending"), "n_id": (0.9, "pending"),
    }
    confirmed = R.confirm(model, stored)
    assert rows(confirmed.select("to", "to_column")) == [("a", "y_id"), ("m", "id")]


def test_overrides_add_new_names_only(spark):
    model = rel(spark, ("one", "a", "id", "b", "a_id", 0.9))
    over = rel(spark, ("one", "x", "id", "y", "x_id", 1.0), ("two", "x", "id", "y", "x_id", 1.0), (None, "q", "id", "r", "q_id", 1.0))
    assert rows(R.apply_overrides(model, over).select("name", "from")) == [("one", "a"), ("two", "x")]


def test_unique_keys_need_every_row(spark):
    tables = {
        "a": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "x_id int, y_id int"),
        "b": spark.createDataFrame([(1,), (None,)], "x_id int"),
        "c": spark.createDataFrame([], "x_id int"),
    }
    measured = R.measure(tables, R.key_columns(tables))
    assert rows(R.unique_keys(tables, measured)) == [("a", "x_id")]


def test_sketches_decide_what_they_can(spark, monkeypatch):
    """The same relationships as by measuring, and no value of small or hopeless pairs is measured."""
    wide = spark.range(60_000)
    tables = {
        "big": wide.select("id"),
        "small": spark.range(500).select("id"),
        "in_big": wide.select((F.col("id") * 2).alias("big_id")).filter("big_id < 100000"),
        "half_big": wide.select((F.col("id") + 29_000).alias("big_id")),
        "out_big": wide.select((F.col("id") + 10_000_000).alias("big_id")),
        "in_small": spark.range(300).select((F.col("id") % 40).alias("small_id"), F.lit(None).cast("long").alias("none_id")),
        "text_small": spark.range(300).select((F.col("id") % 900).cast("string").alias("small_id")),
        "nothing": spark.range(0).select(F.col("id").alias("small_id")),
    }
    cols = [(m, c) for m, df in tables.items() for c in df.columns]
    cat = catalog(spark, [("main", m, c, "VARCHAR" if m == "text_small" else "BIGINT") for m, c in cols])
    refs = [(m, c) for m, c in cols if c != "id"]
    both = spark.createDataFrame(
        [(m, c, c.split("_")[0] if c != "none_id" else "small", "id") for m, c in refs], "fk_model string, fk_column string, pk_model string, pk_column string"
    )
    both = both.join(R._side(cat, "fk"), ["fk_model", "fk_column"]).join(R._side(cat, "pk"), ["pk_model", "pk_column"])
    plain = rows(R.inclusion(tables, both))
    asked, measure = [], R.measure
    monkeypatch.setattr(R, "measure", lambda t, columns, *a, **k: asked.extend(columns) or measure(t, columns, *a, **k))
    found = R.sketches(tables, cols)
    assert rows(R.inclusion(tables, both, sketched=found)) == plain and len(plain) == 4
    assert sorted(set(asked)) == [("big", "id"), ("half_big", "big_id"), ("in_big", "big_id")]
    assert rows(R.unique_by_sketch(tables, found)) == sorted(
        [("big", "id"), ("small", "id"), ("in_big", "big_id"), ("half_big", "big_id"), ("out_big", "big_id"), ("text_small", "small_id")], key=repr
    )


def test_appended_conditions_are_quoted_and_reconciled(spark):
    cat = catalog(spark, [("main", "users", "id", "BIGINT"), ("main", "posts", "user id", "VARCHAR"), ("main", "likes", "user_id", "BIGINT")])
    empty = R.inclusion({}, spark.createDataFrame([], "fk_model string, fk_column string, pk_model string, pk_column string").join(
        R._side(cat, "fk"), ["fk_model", "fk_column"]).join(R._side(cat, "pk"), ["pk_model", "pk_column"]))
    found = spark.createDataFrame([("posts", "user id", "users", "id"), ("likes", "user_id", "users", "id")], "from_table string, from_column string, to_table string, to_column string")
    got = {r.to: r.condition for r in R.append(empty, found, "source_constraint", "_srcfk", catalog=cat).collect()}
    assert got["likes"] == "`users`.`id` = `likes`.`user_id`"
    assert got["posts"] == "CAST(`users`.`id` AS STRING) = CAST(`posts`.`user id` AS STRING)"
    users = spark.createDataFrame([(1,), (2,)], "id long")
    posts = spark.createDataFrame([("1",), ("x",)], "`user id` string")
    assert users.alias("users").join(posts.alias("posts"), F.expr(got["posts"])).count() == 1
