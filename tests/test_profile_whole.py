"""The registered one-pass profile has the number of distinct values of every column."""

import json

from siltstone.suite import load_all
from siltstone.suite.registry import QUERIES
from siltstone.suite.tables import SCHEMAS

load_all()


def distinct(column):
    return len({json.dumps(v) for v in column if v is not None})


def test_profile_single_pass_has_exact_distinct_counts(spark, tmp_path):
    want = {}
    for name, schema in SCHEMAS.items():
        # 2,500 ids, more than a sketch counts exactly; other columns repeat, some have NULLs.
        keys = range(2500 if name in ("orders", "embeddings") else 40)
        columns = {}
        for j, (c, kind) in enumerate(f.split(" ") for f in schema.split(", ")):
            ids = [i if j == 0 else None if j % 2 == 0 and i % 7 == 0 else i % (3 + 8 * j) for i in keys]
            columns[c] = ids, {"array<float>": "array(CAST({} AS FLOAT), 0.5F)", "timestamp_ntz": "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, {})"}.get(kind, f"CAST({{}} AS {kind})")
        raw = spark.createDataFrame(list(zip(*[v for v, _ in columns.values()])), ", ".join(f"{c} bigint" for c in columns))
        typed = raw.selectExpr(*[f"IF({c} IS NULL, NULL, {cast.format(c)}) AS {c}" for c, (_, cast) in columns.items()])
        assert typed.dtypes == [tuple(f.split(" ")) for f in schema.split(", ")]
        typed.write.parquet(f"{tmp_path}/{name}.parquet")
        want |= {(name, c): (len(keys), distinct(v)) for c, (v, _) in columns.items()}
    got = QUERIES["profile_single_pass"](spark, str(tmp_path))
    assert {"cardinality", "plausible"} <= set(got.columns)
    assert {(r.model, r.column_name): (r.row_count, r.cardinality) for r in got.collect()} == want
