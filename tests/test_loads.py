import random
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siltstone.operators import layers as L
from siltstone.operators import merge as G
from siltstone.operators import sync as S
from siltstone.operators import versions as V

SHAPE = "id int, v string, updated_at int"


def frame(spark, data, shape=SHAPE):
    return spark.createDataFrame(data, shape)


def stored(spark, lake, name="t"):
    return rows(V.read(spark, lake.bronze("s", name)))


def test_versions_replace_append_and_log(spark, tmp_path):
    root = str(tmp_path / "t")
    assert V.latest(spark, root) is None and V.schema(spark, root) is None and V.high_water(spark, root, "id") is None
    assert V.replace(frame(spark, [(1, "a", 5), (2, "b", 7)]), root, "updated_at") == 2
    assert V.append(frame(spark, [(3, "c", 6)]), root, "updated_at") == 1
    v = V.latest(spark, root)
    assert (v.version, v.mode, v.rows, v.total_rows, v.high_water, len(v.segments)) == (2, "append", 1, 3, "7", 2)
    assert rows(V.read(spark, root)) == [(1, "a", 5), (2, "b", 7), (3, "c", 6)]
    assert V.append(frame(spark, []), root) == 0 and V.latest(spark, root).version == 2
    assert V.replace(frame(spark, []), root) == 0 and V.latest(spark, root).version == 2
    V.append(frame(spark, [(4, 1.5)], "id int, extra double"), root)
    assert rows(V.read(spark, root).select("id", "v", "extra"))[-1] == (4, None, 1.5)
    with pytest.raises(TypeError):
        V.append(frame(spark, [("x",)], "id string"), root)
    assert V.log(spark, root).count() == 3
    with pytest.raises(ValueError):
        V.read(spark, str(tmp_path / "nowhere"))


def test_a_failed_load_stays_invisible(spark, tmp_path):
    root = str(tmp_path / "t")
    V.replace(frame(spark, [(1, "a", 1)]), root)
    broken = frame(spark, [(2, "b", 2)]).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        V.replace(broken, root)
    assert rows(V.read(spark, root)) == [(1, "a", 1)]
    V.replace(frame(spark, [(3, "c", 3)]), root)
    assert rows(V.read(spark, root)) == [(3, "c", 3)]


def test_bronze_write_read_and_drift(spark, lake):
    first = L.write_bronze(lake, "s", "t", frame(spark, [(1, "a", 1), (2, "b", 2)]))
    assert first.count() == 0
    changes = L.write_bronze(lake, "s", "t", frame(spark, [(1, 2.0)], "id int, w double"))
    assert {(r.column_name, r.change_type) for r in changes.collect()} == {
        ("v", "column_removed"), ("updated_at", "column_removed"), ("w", "column_added"),
    }
    assert rows(L.read_bronze(spark, lake, "s", "t", ["w"], 1)) == [(2.0,)]
    with pytest.raises(ValueError):
        L.write_bronze(lake, "s", "t", frame(spark, [("x",)], "id string"), "freeze")
    assert rows(L.read_bronze(spark, lake, "s", "t", ["id"])) == [(1,)]
    L.write_bronze(lake, "s", "t", frame(spark, [], "id int, w double"))
    assert L.read_bronze(spark, lake, "s", "t").count() == 1
    counts = L.row_counts({"a": frame(spark, [(1, "a", 1)]), "b": frame(spark, [])})
    assert rows(counts) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize(
    "cursor, key, want", [(None, None, "view"), ("c", None, "full"), (None, ["k"], "full"), ("c", ["k"], "incremental")]
)
def test_strategy_follows_what_is_declared(cursor, key, want):
    assert L.choose_strategy(cursor, key) == want


def test_late_ties_and_rows_without_cursor_come_once(spark, lake):
    shape = "v string, updated_at int"
    first = [("a", 1), ("n", None), ("n", None)]
    for part in ([*first], [*first, ("b", 1), ("b", 1)], [*first, ("b", 1), ("b", 1), ("c", 2)]):
        S.load(lake, "s", "t", frame(spark, part, shape), cursor="updated_at", incremental=True)
    assert stored(spark, lake) == [("a", 1), ("b", 1), ("b", 1), ("c", 2), ("n", None), ("n", None)]


def test_a_view_follows_and_a_dropped_table_goes(spark, lake):
    L.write_bronze(lake, "s", "v", frame(spark, [(1, "a", 1)]))
    L.materialize(spark, lake, "s", "v")
    L.write_bronze(lake, "s", "v", frame(spark, [(1, "a", 1), (2, "b", 1)]))
    assert spark.table("s__v").count() == 2
    assert V.clean(spark, lake.bronze("s", "v")) == ["v00000001"]
    assert L.drop(spark, lake, "bronze", "s", "v") and not L.drop(spark, lake, "bronze", "s", "v")
    assert not spark.catalog.tableExists("s__v") and V.latest(spark, lake.bronze("s", "v")) is None


def test_a_broken_first_commit_is_no_version(spark, lake):
    root = lake.bronze("s", "x")
    spark.createDataFrame([], V.LOG).write.json(f"{root}/_loads")
    assert V.latest(spark, root) is None
    V.append(frame(spark, [(1, "a", 1)]), root)
    assert stored(spark, lake, "x") == [(1, "a", 1)]


def silver(spark):
    return rows(spark.table("s__t"))


def test_view_and_full(spark, lake):
    L.write_bronze(lake, "s", "t", frame(spark, [(1, "a", 1)]))
    assert L.materialize(spark, lake, "s", "t")["type"] == "view"
    assert silver(spark) == [(1, "a", 1)] and V.latest(spark, lake.silver("s", "t")) is None
    report = L.materialize(spark, lake, "s", "t", "full")
    assert (report["type"], report["rows"]) == ("table", 1)
    assert V.latest(spark, lake.silver("s", "t")).total_rows == 1


def test_incremental_is_strict_and_skips_missing_cursors(spark, lake):
    L.write_bronze(lake, "s", "t", frame(spark, [(1, "a", 1), (2, "b", 5), (3, "n", None)]))
    assert L.materialize(spark, lake, "s", "t", "incremental", "updated_at")["type"] == "table"
    L.write_bronze(lake, "s", "t", frame(spark, [(2, "x", 5), (4, "d", 5), (5, "e", 6), (6, "f", 4), (7, "g", None)]))
    report = L.materialize(spark, lake, "s", "t", "incremental", "updated_at")
    assert (report["type"], report["rows"]) == ("incremental", 1)
    assert silver(spark) == [(1, "a", 1), (2, "b", 5), (3, "n", None), (5, "e", 6)]
    L.write_bronze(lake, "s", "t", frame(spark, [(8, "h", 6), (5, "e2", 6)]))
    report = L.materialize(spark, lake, "s", "t", "incremental", "updated_at", "merge", ["id"])
    assert report["rows"] == 2
    assert silver(spark) == [(1, "a", 1), (2, "b", 5), (3, "n", None), (5, "e2", 6), (8, "h", 6)]


def test_incremental_without_any_cursor_value_is_full(spark, lake):
    L.write_bronze(lake, "s", "t", frame(spark, [(1, "a", None)]))
    L.materialize(spark, lake, "s", "t", "incremental", "updated_at")
    L.write_bronze(lake, "s", "t", frame(spark, [(2, "b", None)]))
    assert L.materialize(spark, lake, "s", "t", "incremental", "updated_at")["type"] == "table"
    assert silver(spark) == [(2, "b", None)]


def test_materialize_all_reports_failures(spark, lake):
    L.write_bronze(lake, "s", "t", frame(spark, [(1, "a", 1)]))
    report = L.materialize_all(spark, lake, "s", ["t", "gone"])
    assert [(r.table, r.status, r.type) for r in report.collect()] == [("t", "success", "view"), ("gone", "error", None)]


def brute_merge(target, increments):
    """Newest row per id by cursor (missing is oldest), incoming on ties; one batch holds no doubles."""
    state = {r[0]: r for r in target}
    for batch in increments:
        for r in batch:
            old = state.get(r[0])
            age = lambda x: -1 if x[2] is None else x[2]
            if old is None or age(r) >= age(old):
                state[r[0]] = r
    return sorted(state.values(), key=repr)


def test_merge_equals_brute_force_in_any_row_order(spark, tmp_path):
    rng = random.Random(7)
    target = [(i, f"t{i}", rng.choice([None, *range(9)])) for i in range(30)]
    batches = [
        [(i, f"b{n}-{i}", rng.choice([None, *range(9)])) for i in rng.sample(range(45), 20)] for n in range(3)
    ]
    want = brute_merge(target, batches)
    for seed, share in ((0, 0.0), (1, 99.0)):
        shuffle = lambda xs: random.Random(seed).sample(xs, len(xs))
        root = str(tmp_path / f"t{seed}")
        V.merge_into(frame(spark, shuffle(target)), root, ["id"], "updated_at")
        for b in batches:
            V.merge_into(frame(spark, shuffle(b)), root, ["id"], "updated_at", compact_share=share)
        assert rows(V.read(spark, root)) == want
        V.merge_into(frame(spark, batches[-1]), root, ["id"], "updated_at", compact_share=share)
        assert rows(V.read(spark, root)) == want
        assert len(V.latest(spark, root).deltas) == (4 if share else 0)
        assert V.compact(spark, root).base_rows == len(want)
        assert rows(V.read(spark, root)) == want


def test_merge_without_cursor_takes_the_incoming_row(spark):
    merged = G.merge(frame(spark, [(1, "a", 9), (2, "b", 9)]), frame(spark, [(2, "new", 1), (3, "c", 1)]), ["id"])
    assert rows(merged) == [(1, "a", 9), (2, "new", 1), (3, "c", 1)]


def test_deltas_without_cursor_new_columns_and_other_keys(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    V.merge_into(frame(spark, [(i, "base", i) for i in range(5)]), root, ["id"])
    V.merge_into(frame(spark, [(1, "one", 0), (7, "seven", 0)]), root, ["id"], compact_share=99)
    V.merge_into(frame(spark, [(1, "again", 0, 2.5)], SHAPE + ", extra double"), root, ["id"], compact_share=99)
    assert rows(V.read(spark, root).filter("id IN (0, 1, 7)")) == [(0, "base", 0, None), (1, "again", 0, 2.5), (7, "seven", 0, None)]
    assert len(V.latest(spark, root).deltas) == 2
    V.append(frame(spark, [(1, "extra row", 0)]), root)
    assert V.latest(spark, root).deltas == [] and V.read(spark, root).filter("id = 1").count() == 2
    V.merge_into(frame(spark, [(1, "by v", 3)]), root, ["v"], compact_share=99)
    V.merge_into(frame(spark, [(1, "by id", 3)]), root, ["id"], compact_share=99)
    assert rows(V.read(spark, root).filter("id = 1").select("v")) == [("by id",)]
    monkeypatch.setattr(V, "MAX_DELTAS", 3)
    for n in range(4):
        V.merge_into(frame(spark, [(1, f"n{n}", 3), (10 + n, "x", 3)]), root, ["id"], compact_share=99)
    assert "fold" in {r.mode for r in V.log(spark, root).collect()} and len(V.latest(spark, root).deltas) < 3
    assert rows(V.read(spark, root).filter("id = 1 OR id >= 10").select("id", "v")) == [(1, "n3"), *[(10 + n, "x") for n in range(4)]]


def test_small_merges_leave_the_base_files_alone(spark, tmp_path):
    root = str(tmp_path / "t")
    V.replace(spark.range(1000).select(F.col("id").cast("int").alias("id"), F.lit("v").alias("v"), F.lit(1).alias("updated_at")), root, "updated_at")
    V.merge_into(frame(spark, [(3, "new", 2), (4, "old", 0)]), root, ["id"], "updated_at")
    v = V.latest(spark, root)
    assert (v.segments, len(v.deltas), v.high_water, v.base_rows) == (["v00000001"], 1, "2", 1000)
    assert rows(V.read(spark, root).filter("id IN (3, 4)")) == [(3, "new", 2), (4, "v", 1)]
    assert V.read(spark, root).count() == 1000


def test_repeated_keys_in_one_increment(spark):
    data = [(1, "old", 1), (1, "new", 2)] + [(2, "x", 3)] * 50
    assert rows(G.dedupe(frame(spark, data), ["id"], "updated_at")) == [(1, "new", 2), (2, "x", 3)]
    twice = [rows(G.dedupe(frame(spark, d), ["id"])) for d in (data, data[::-1])]
    assert twice[0] == twice[1] and len(twice[0]) == 2


def test_rows_without_a_key_are_all_kept_and_merged_once(spark, tmp_path):
    root = str(tmp_path / "t")
    batch = frame(spark, [(None, "a", 1), (None, "b", 1), (None, "a", 1), (1, "c", 1)])
    for _ in range(2):
        V.merge_into(batch, root, ["id"], "updated_at")
    assert rows(V.read(spark, root)) == [(1, "c", 1), (None, "a", 1), (None, "b", 1)]


def test_merge_takes_in_new_columns(spark):
    new = frame(spark, [(2, "b", 2, 1.5)], SHAPE + ", extra double")
    assert rows(G.merge(frame(spark, [(1, "a", 1)]), new, ["id"])) == [(1, "a", 1, None), (2, "b", 2, 1.5)]


def test_composite_keys(spark):
    shape = "a int, b int, v string"
    merged = G.merge(frame(spark, [(1, 1, "x"), (1, 2, "y")], shape), frame(spark, [(1, 2, "z")], shape), ["a", "b"])
    assert rows(merged) == [(1, 1, "x"), (1, 2, "z")]


def test_load_dispositions(spark, lake):
    df = frame(spark, [(1, "a", 1)])
    assert S.load(lake, "s", "t", df)["mode"] == "replace"
    assert S.load(lake, "s", "t", df, incremental=True)["mode"] == "merge"
    assert stored(spark, lake) == [(1, "a", 1)]
    keyless = df.select("v", "updated_at")
    assert S.load(lake, "s", "u", keyless, incremental=True)["mode"] == "append"
    S.load(lake, "s", "u", keyless, incremental=True)
    assert stored(spark, lake, "u") == [("a", 1), ("a", 1)]


def test_incremental_loads_equal_a_full_load(spark, lake):
    parts = [[(1, "a", 1), (2, "b", 2)], [(2, "b2", 3), (3, "c", 3)], [(4, "n", None), (1, "a4", 4)]]
    seen: list = []
    for part in parts:
        seen = [r for r in seen if r[0] not in {p[0] for p in part}] + part
        report = S.load(lake, "s", "t", frame(spark, seen), None, "updated_at", True)
        assert report["is_incremental"] and report["rows_synced"] >= len(part)
    S.load(lake, "s", "full", frame(spark, seen))
    assert stored(spark, lake) == stored(spark, lake, "full")


def test_first_cursor_and_missing_values(spark, lake):
    shape = "id int, updated_at timestamp"
    from datetime import datetime, timezone

    at = lambda y: datetime(y, 1, 1, tzinfo=timezone.utc)
    S.load_incremental(lake, "s", "t", frame(spark, [(1, at(1960)), (2, at(1980)), (3, None)], shape))
    assert [r[0] for r in stored(spark, lake)] == [2, 3]


def test_type_change_reloads_in_full_or_fails(spark, lake):
    S.load(lake, "s", "t", frame(spark, [(1, "a", 1)]), incremental=True)
    changed = frame(spark, [(1, 5, 2), (2, 6, 2)], "id int, v int, updated_at int")
    failed = S.load(lake, "s", "t", changed, incremental=True, fallback=False)
    assert failed["status"] == "failed" and stored(spark, lake) == [(1, "a", 1)]
    report = S.load(lake, "s", "t", changed, incremental=True)
    assert (report["status"], report["mode"], report["is_incremental"]) == ("success", "replace", False)
    assert report["schema_changes"] == 1 and report["schema_review_required"]
    assert stored(spark, lake) == [(1, 5, 2), (2, 6, 2)]
    frozen = S.load(lake, "s", "t", frame(spark, [(1,)], "id int"), policy="freeze")
    assert frozen["status"] == "failed" and stored(spark, lake) == [(1, 5, 2), (2, 6, 2)]


def test_run_reports_every_table(spark, lake):
    report = S.run(lake, "s", {"a": frame(spark, [(1, "a", 1)]), "b": frame(spark, [])})
    assert [(r.table, r.rows_synced, r.status) for r in report.collect()] == [("a", 1, "success"), ("b", 0, "success")]
    assert spark.read.parquet(f"{lake.base}/_syncs").count() == 2


def test_is_due(spark):
    from datetime import datetime

    now = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame(
        [(None, 10), (datetime(2024, 1, 1, 11), None), (datetime(2024, 1, 1, 11, 30), None), (datetime(2024, 1, 1, 11, 57), 1),
         (datetime(2024, 1, 1, 11, 55), 1)],
        "last timestamp_ntz, every int",
    )
    got = [r[0] for r in df.select(S.is_due(F.col("last"), F.col("every"), F.lit(now).cast("timestamp_ntz"))).collect()]
    assert got == [True, True, False, False, True]


def test_small_increment_leaves_the_target_unshuffled(spark, tmp_path):
    spark.range(100_000).select(F.col("id").cast("int").alias("id"), F.lit("t").alias("v"), F.lit(1).alias("updated_at")).write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    frame(spark, [(1, "n", 2)]).write.parquet(str(tmp_path / "i"))
    plan = G.merge(target, spark.read.parquet(str(tmp_path / "i")), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_an_edge_with_maps_is_compared(spark, lake):
    """Rows at the newest cursor value are added once, copies counted, also where a column is a map."""
    schema = "at int, tags map<string,int>"
    first = spark.createDataFrame([(1, {"a": 1}), (2, {"b": 2}), (2, {"b": 2}), (None, {"n": 0})], schema)
    later = spark.createDataFrame([(2, {"b": 2}), (2, {"b": 2}), (2, {"b": 2}), (2, {"c": 3}), (3, None), (None, {"n": 0}), (None, None)], schema)
    S.load(lake, "s", "t", first, cursor="at", incremental=True)
    report = S.load(lake, "s", "t", later, cursor="at", incremental=True)
    assert report["is_incremental"] and report["rows_synced"] == 4
    assert V.read(spark, lake.bronze("s", "t")).count() == 8


def test_only_the_newest_log_entry_is_read(spark, lake):
    root = lake.bronze("s", "t")
    for k in range(3):
        V.append(spark.range(k, k + 2), root, batch=f"q:{k}")
    assert V.latest(spark, root).version == 3 and V.log(spark, root).count() == 3
    assert V.has_batch(spark, root, "q:1") and not V.has_batch(spark, root, "q:3")
    for entry in sorted(Path(root, "_loads").iterdir())[:2]:
        for part in entry.glob("part-*"):
            part.write_text("not json at all")
    assert V.latest(spark, root).version == 3 and V.read(spark, root).count() == 6
