from conftest import rows
from pyspark.sql import functions as F

from siltstone.operators import versions as V
from siltstone.streaming import stream as ST

SHAPE = "id int, v string, at timestamp"


def put(spark, folder, data):
    df = spark.createDataFrame(data, "id int, v string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, **options):
    return ST.read_files(spark, folder, SHAPE, **options)


def test_merge_stream_follows_new_files(spark, tmp_path):
    src, root, cp = (str(tmp_path / n) for n in ("src", "t", "cp"))
    put(spark, src, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")])
    ST.sync(stream(spark, src), root, cp, ["id"], "at", "m1").awaitTermination()
    put(spark, src, [(2, "late", "2024-01-01"), (1, "new", "2024-01-03"), (3, "n", None)])
    ST.sync(stream(spark, src), root, cp, ["id"], "at", "m1").awaitTermination()
    assert rows(V.read(spark, root).select("id", "v")) == [(1, "new"), (2, "b"), (3, "n")]
    before = V.latest(spark, root).version
    ST.sync(stream(spark, src), root, cp, ["id"], "at", "m1").awaitTermination()
    assert V.latest(spark, root).version == before


def test_appended_batch_is_not_doubled_when_delivered_again(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    put(spark, src, [(1, "a", "2024-01-01")])
    # A lost checkpoint makes Spark deliver batch 0 once more.
    for cp in ("cp1", "cp2"):
        ST.sync(stream(spark, src), root, str(tmp_path / cp), name="a1").awaitTermination()
    assert V.read(spark, root).count() == 1


def test_file_by_file_equals_one_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    for day in (3, 1, 2):
        put(spark, src, [(i, f"d{day}", f"2024-01-0{day}") for i in range(day + 2)])
    results = []
    for n in (None, 1):
        root = str(tmp_path / f"t{n}")
        q = ST.sync(stream(spark, src, files_per_trigger=n), root, f"{root}-cp", ["id"], "at", f"f{n}")
        q.awaitTermination()
        results.append(rows(V.read(spark, root)))
    assert results[0] == results[1] and len(results[0]) == 5
    assert V.log(spark, str(tmp_path / "t1")).filter("batch IS NOT NULL").count() == 3


def test_windows_are_updated_across_runs(spark, tmp_path):
    src, root, cp = (str(tmp_path / n) for n in ("src", "t", "cp"))
    for data in ([(1, "a", "2024-01-01 00:10:00"), (2, "a", "2024-01-01 01:10:00")], [(3, "a", "2024-01-01 01:20:00"), (4, "b", "2024-01-01 01:30:00")]):
        put(spark, src, data)
        w = ST.windowed(stream(spark, src), "at", "1 hour", "1 day", ["v"], {"n": F.count(F.lit(1))})
        ST.live_metric(w, root, cp, ["v"], "w1").awaitTermination()
    got = V.read(spark, root).select(F.hour("window_start"), "v", "n")
    assert rows(got) == [(0, "a", 1), (1, "a", 2), (1, "b", 1)]


def test_dedupe_within_watermark(spark, tmp_path):
    src, root, cp = (str(tmp_path / n) for n in ("src", "t", "cp"))
    put(spark, src, [(1, "a", "2024-01-01"), (1, "again", "2024-01-01 01:00:00"), (2, "b", "2024-01-01")])
    once = ST.dedupe(stream(spark, src), ["id"], "at", "1 day").select("id")
    ST.sync(once, root, cp, name="d1").awaitTermination()
    assert rows(V.read(spark, root)) == [(1,), (2,)]
