"""Documents of unknown shape against a merge by hand."""

import json

from conftest import rows
from siltstone.sources import untyped

DOCS = [
    {"_id": 1, "a": 1, "b": {"c": "x", "C": 2.5}, "t": [1, 2], "e": {}, "n": None},
    {"_id": 2, "a": "q", "b": {"c": "y", "d e": True}, "A": 3, "items": [{"k": 1}, {"k": 2, "w": "z"}]},
    {"_id": 3, "a": {"k": 1}, "it's?": 7, "b__c": "own", "f": 1},
    {"_id": 4, "a": [1, "x"], "f": 2.5, "items": [{"w": 5}], "mixed": [1, "x", {"y": 1}]},
]


def write(path, *lines):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(lines))
    return str(path)


def test_shapes_are_merged(spark, tmp_path):
    at = write(tmp_path / "d", *map(json.dumps, DOCS))
    docs = untyped.read(spark, at)
    got = untyped.shred(docs.drop("rejected"), untyped.merged_type(docs)).orderBy("_id").collect()
    first, second, third, fourth = (r.asDict(recursive=True) for r in got)
    # A name differs from another by its case alone: the second in order gets a number.
    a, upper = ("a", "A") if first.get("a") == "1" else ("a__2", "A")
    assert [r[a] for r in (first, second, third, fourth)] == ["1", "q", '{"k":1}', '[1,"x"]'] and second[upper] == 3
    assert {float(v) for k, v in first.items() if k.lower().startswith("b__c") and v not in (None, "x")} == {2.5}
    assert [v for k, v in second.items() if k.lower().startswith("b__c") and v] == ["y"]
    assert [v for k, v in third.items() if k.lower().startswith("b__c") and v] == ["own"]
    assert second["b__d e"] is True and first["t"] == [1, 2] and first["e"] == "{}" and first["n"] is None
    assert third["it's?"] == 7 and first["it's?"] is None
    assert (float(third["f"]), float(fourth["f"])) == (1.0, 2.5)
    assert second["items"] == [{"k": 1, "w": None}, {"k": 2, "w": "z"}] and fourth["items"] == [{"k": None, "w": "5"}]
    assert fourth["mixed"] == ["1", "x", '{"y":1}']
    assert len({c.lower() for c in first}) == len(first)


def test_result_is_stored(spark, tmp_path):
    docs = untyped.read(spark, write(tmp_path / "d", *map(json.dumps, DOCS)))
    table = untyped.shred(docs, untyped.merged_type(docs))
    table.write.parquet(str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(table)


def test_what_is_no_object_is_told(spark, tmp_path):
    at = write(tmp_path / "d", '{"k": 1}', "", "  ", "bad{", "7", "null", '"text"', '{"k": 1, "k": 2}', '[{"k": 2}, 5, {"k": 3}]', "[]")
    docs = untyped.read(spark, at)
    table = untyped.shred(docs, untyped.merged_type(docs))
    assert table.columns == ["rejected", "k"]
    assert sorted(r.k for r in table.filter("rejected IS NULL").collect()) == [1, 2, 3]
    assert sorted(r.rejected for r in table.filter("rejected IS NOT NULL").collect()) == sorted(
        ["bad{", "7", "null", '"text"', '{"k": 1, "k": 2}', "5"]
    )


def test_other_columns_and_whole_files(spark, tmp_path):
    at = write(tmp_path / "d", json.dumps([{"k": 1, "note": "x"}, {"k": "two"}], indent=2))
    docs = untyped.read(spark, at, whole_files=True).selectExpr("'own' AS K", "doc", "rejected")
    got = untyped.shred(docs, untyped.merged_type(docs))
    assert got.columns == ["K", "rejected", "k__2", "note"]
    assert rows(got) == [("own", None, "1", "x"), ("own", None, "two", None)]


def test_nothing_to_learn(spark, tmp_path):
    docs = untyped.read(spark, write(tmp_path / "d", "bad", "5"))
    shape = untyped.merged_type(docs)
    assert shape.fields == [] and untyped.shred(docs, shape).columns == ["rejected"]
    none = untyped.read(spark, write(tmp_path / "none", ""))
    assert none.count() == 0 and untyped.merged_type(none).fields == []
