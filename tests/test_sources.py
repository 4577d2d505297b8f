import io
import tarfile
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siltstone.sources import documents as D
from siltstone.sources import archives, export, files
from siltstone.sources import social as P
from siltstone.sources import tables as TB


def test_csv_with_header_types_and_key(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\nx,1\ny,2\n,3\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "n"] and dict(df.dtypes)["n"] == "int"
    ids = [r.id for r in df.collect()]
    assert len(set(ids)) == 4
    assert sorted(ids) == sorted(r.id for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect())
    (tmp_path / "b.csv").write_text("id,name\n7,x\n")
    assert rows(files.read_csv(spark, str(tmp_path / "b.csv"))) == [(7, "x")]


def test_keys_do_not_depend_on_how_files_are_split(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a\n" + "same\n" * 4000 + f"only{i}\n")
    whole = {r.id for r in files.read_csv(spark, str(tmp_path), "a string").collect()}
    assert len(whole) == 12_003
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert {r.id for r in files.read_csv(spark, str(tmp_path), "a string").collect()} == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_schema_of(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\n")
    assert files.schema_of(spark, str(tmp_path / "a.csv")).simpleString() == "struct<name:string,n:int>"
    spark.range(1).write.parquet(str(tmp_path / "p"))
    assert files.schema_of(spark, str(tmp_path / "p")).simpleString() == "struct<id:bigint>"


def archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in members.items():
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    archive(tmp_path / "one.tar.gz", {"b.csv": "k,v\n9,z\n", "a.csv": 'k,v\n1,"x, y"\n2,ü\n', "notes.txt": "no"})
    archive(tmp_path / "two.tar.gz", {"dir/c.csv": "k,v\n" + "".join(f"{i},r\n" for i in range(10_000))})
    archive(tmp_path / "none.tar.gz", {"readme.txt": "no"})
    df = archives.read_archives(spark, str(tmp_path), "k int, v string", first_only=True)
    assert rows(df.filter(F.col("archive").contains("one")).select("member", "k", "v")) == [("a.csv", 1, "x, y"), ("a.csv", 2, "ü")]
    assert df.filter(F.col("archive").contains("two")).agg(F.count("*"), F.sum("k")).first() == (10_000, 49_995_000)
    every = archives.read_archives(spark, str(tmp_path), "k int, v string")
    assert rows(every.groupBy("member").count()) == [("a.csv", 2), ("b.csv", 1), ("dir/c.csv", 10_000)]


def test_archive_members_of_both_kinds(spark, tmp_path):
    import pandas as pd

    path = tmp_path / "p.parquet"
    pd.DataFrame({"v": ["p", None], "k": [7, 8], "more": [1, 2]}).to_parquet(path)
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        tar.add(path, "in/p.parquet")
        data = b'k,v\n1,"two\nlines"\nbad,\n\n3\n4,x,extra\n'
        info = tarfile.TarInfo("q.csv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
        tar.addfile(tarfile.TarInfo("empty.csv"), io.BytesIO())
    got = archives.read_archives(spark, str(tmp_path), "k int, v string").select("member", "k", "v")
    assert rows(got) == rows(
        spark.createDataFrame(
            [("in/p.parquet", 7, "p"), ("in/p.parquet", 8, None), ("q.csv", 1, "two\nlines"), ("q.csv", None, None), ("q.csv", 3, None), ("q.csv", 4, "x")],
            "member string, k int, v string",
        )
    )


def test_an_archive_is_streamed(spark, tmp_path):
    """Archives larger than a batch and than what is read at a time; what a task holds does not grow with them."""
    import random
    import tracemalloc

    rnd = random.Random(3)
    held = []
    for n in (30_000, 120_000):
        folder = tmp_path / str(n)
        folder.mkdir()
        archive(folder / "big.tar.gz", {"a.csv": "k,v\n" + "".join(f"{i},{rnd.randbytes(60).hex()}\n" for i in range(n))})
        assert (folder / "big.tar.gz").stat().st_size > 2 * archives.READ_BYTES
        reader = archives.ArchiveReader(str(folder), ["k", "v"], False)
        tracemalloc.start()
        sizes = [b.num_rows for b in reader.read(reader.partitions()[0])]
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sum(sizes) == n and max(sizes) == archives.BATCH_ROWS
    assert held[1] < 1.3 * held[0]
    got = archives.read_archives(spark, f"file://{tmp_path}/120000", "k int, v string")
    assert got.agg(F.count("*"), F.sum("k"), F.countDistinct("v")).first() == (120_000, 7_199_940_000, 120_000)
    assert got.select("archive").distinct().first()[0] == f"file://{tmp_path}/120000/big.tar.gz"


@pytest.mark.parametrize("left", [0, 5, 300, -600, -4])
def test_no_archive_and_damaged_ones(spark, tmp_path, left):
    assert archives.read_archives(spark, str(tmp_path), "k int").collect() == []
    archive(tmp_path / "cut.tar.gz", {f"{m}.csv": "k\n" + "".join(f"{i * 7919 % 10007}\n" for i in range(500)) for m in "abcdefgh"})
    whole = (tmp_path / "cut.tar.gz").read_bytes()
    assert archives.read_archives(spark, str(tmp_path), "k int").count() == 4000
    (tmp_path / "cut.tar.gz").write_bytes(whole[:left])
    with pytest.raises(Exception, match="EOFError|ReadError"):
        archives.read_archives(spark, str(tmp_path), "k int").collect()


def test_cursor_helpers(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, created_at int")
    assert TB.pick_cursor(df) == "created_at"
    assert TB.pick_cursor(df.withColumn("updated_at", F.lit(1))) == "updated_at"
    assert TB.pick_cursor(df.select("id")) is None
    assert TB.high_water_mark(df, "created_at").first()[0] == 7
    assert rows(TB.read_since(df, "created_at", F.lit(5))) == [(3, 7)]
    assert TB.read_since(df, "created_at", None).count() == 3


@pytest.mark.parametrize("low, high, count", [(1, 10, 5), (1, 100, 5_500_000), (-50, 49, 3_000_000), (5, 5, 9_000_000)])
def test_partition_predicates_hold_each_row_once(spark, low, high, count):
    df = spark.range(low - 3, high + 4).select(F.col("id").alias("k")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    parts = [df.filter(p).count() for p in TB.partition_predicates("k", low, high, count)]
    assert sum(parts) == df.count()
    assert len(parts) == max(1, min(-(-count // TB.PARTITION_ROWS), high - low + 1))


def test_cursor_predicate():
    assert TB.cursor_predicate("at", None) is None
    assert TB.cursor_predicate("at", datetime(2024, 1, 2, 3)) == "at > '2024-01-02 03:00:00'"
    assert TB.cursor_predicate("at", "o'c") == "at > 'o''c'"
    assert [TB.fetch_size(n) for n in (10, 50_000, 10**6)] == [1000, 5000, 20000]


DOCS = """{"_id": "a", "created": "2024-01-01T10:00:00", "tags": ["x", "y"], "address": {"city": "Q", "geo": {"lat": 1.5}}, "items": [{"sku": "s1", "qty": [1, 2]}, {"sku": "s2", "qty": []}]}
{"_id": "b", "tags": [], "items": null}
{"_id": "c"}
"""
DOC_SCHEMA = (
    "_id string, created timestamp_ntz, tags array<string>, address struct<city: string, geo: struct<lat: double>>, "
    "items array<struct<sku: string, qty: array<int>>>"
)


@pytest.fixture
def docs(spark, tmp_path):
    (tmp_path / "d.json").write_text(DOCS)
    return str(tmp_path / "d.json")


def test_documents_after_a_key(spark, docs):
    assert rows(D.read_documents(spark, docs, DOC_SCHEMA, after="a").select("_id")) == [("b",), ("c",)]


def test_values_are_normalised_at_any_depth(spark):
    t = datetime(2024, 1, 2, 3, 4, 5, 60)
    df = spark.createDataFrame(
        [(t, {"at": t, "n": 1}, [t, None], {"k": t}, None)],
        "a timestamp_ntz, s struct<at: timestamp_ntz, n: int>, l array<timestamp_ntz>, m map<string, timestamp_ntz>, e struct<at: timestamp_ntz>",
    )
    text = "2024-01-02T03:04:05.000060"
    r = D.normalize_values(df).first()
    assert (r.a, r.s.at, r.s.n, r.l, r.m, r.e) == (text, text, 1, [text, None], {"k": text}, None)


def test_lists_become_child_tables(spark, docs):
    tables = D.unnest_children(D.read_documents(spark, docs, DOC_SCHEMA), "orders", "_id")
    assert set(tables) == {"orders", "orders__tags", "orders__items", "orders__items__qty"}
    assert tables["orders"].columns == ["_id", "created", "address__city", "address__geo__lat"]
    assert rows(tables["orders__tags"]) == [("a", "a", 0, "x"), ("a", "a", 1, "y")]
    assert rows(tables["orders__items"]) == [("a", "a", 0, "s1"), ("a", "a", 1, "s2")]
    assert rows(tables["orders__items__qty"]) == [("a", "a/0", 0, 1), ("a", "a/0", 1, 2)]


def post(spark, *items):
    return spark.createDataFrame(list(items), "platform string, payload string")


def test_social_platforms(spark):
    given = [
        ("Reddit", '{"data": {"id": "r-1", "selftext": "0", "ups": 3, "num_comments": 5, "num_crossposts": 7, "view_count": 90, "url": "false"}}'),
        ("reddit", '{"id": 0, "title": "[]", "selftext": 0, "url": false}'),
        ("reddit", '{"data": {"selftext": "", "title": "named"}}'),
        ("x", '{"data": {"id": "0", "text": "false", "public_metrics": {"like_count": 21, "retweet_count": 22, "reply_count": 23, "impression_count": 24}}}'),
        ("x", '{"id": "x-2", "text": false, "public_metrics": {}, "metrics": {"likes": 3, "shares": 4, "comments": 5, "impressions": 6}}'),
        ("x", '{"data": {"id": "x-3", "public_metrics": {"like_count": null, "likes": 9}}}'),
        ("linkedin", '{"id": 0, "urn": "l-1", "commentary": "{}", "media": [{"url": "m"}, {"url": ""}, {"x": 1}], "metrics": {"likes": "7", "shares": 2.9}}'),
        ("linkedin", '{"id": "l-2", "urn": "other", "text": "t", "commentary": "c"}'),
        ("linkedin", '{"text": {}, "commentary": 0}'),
    ]
    got = {(r.platform, r.external_id): (r.content, r.media_urls, tuple(r.metrics)) for r in P.normalize(post(spark, *given)).collect()}
    assert got == {
        ("reddit", "r-1"): ("0", ["false"], (3, 7, 5, 90)),
        ("reddit", "0"): ("[]", [], (0, 0, 0, 0)),
        ("reddit", ""): ("named", [], (0, 0, 0, 0)),
        ("x", "0"): ("false", [], (21, 22, 23, 24)),
        ("x", "x-2"): ("", [], (3, 4, 5, 6)),
        ("x", "x-3"): ("", [], (0, 0, 0, 0)),
        ("linkedin", "l-1"): ("{}", ["m"], (7, 2, 0, 0)),
        ("linkedin", "l-2"): ("t", [], (0, 0, 0, 0)),
        ("linkedin", ""): ("", [], (0, 0, 0, 0)),
    }


def test_unknown_platforms_are_rejected(spark):
    df = post(spark, ("x", "{}"), ("myspace", "{}"), (None, "{}"))
    assert rows(P.rejects(df).select("platform")) == [("myspace",), (None,)]
    assert P.normalize(df).count() == 1


def test_export(spark, tmp_path):
    a = spark.createDataFrame([(1, [1, 2])], "k int, l array<int>")
    b = spark.createDataFrame([("x", datetime(2024, 1, 1, 0, 0, 0, 7))], "k string, at timestamp_ntz")
    both = export.combine({"A": a, "B": b})
    assert both.columns == ["widget", "k", "l", "at"]
    assert rows(both.select("widget", "k", "l")) == [("A", "1", "[1,2]"), ("B", "x", None)]
    out = export.to_csv({"My A": a, "b": b}, str(tmp_path / "csv"))
    assert [p.rsplit("/", 1)[1] for p in out.values()] == ["00_my_a", "01_b"]
    assert rows(spark.read.option("header", True).csv(out["My A"])) == [("1", "[1,2]")]
    back = export.to_json({"b": b}, str(tmp_path / "json"))
    assert spark.read.schema("k string, at timestamp_ntz").json(back["b"]).first().at.microsecond == 7
    assert export.to_csv({}, str(tmp_path)) == {}
    with pytest.raises(ValueError):
        export.combine({})
