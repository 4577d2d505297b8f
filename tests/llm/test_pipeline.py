"""The pipeline's stages and the registered queries on the smallest given tables."""

import random
import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_hits, brute_rules

import __spark_entry__ as entry
import corpus_pipeline
from siltstone.llm.registry import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage was given and returned."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{ROOT}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(f"{at}/{name}")
        got = spark.read.parquet(f"{at}/{name}")
        out.append((docs.toPandas(), got.toPandas()))
        docs = got
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out))


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "benchmark_decontamination", "packing"]


def test_quality(stages):
    given, got = stages["quality_rules"]
    judged = brute_rules(list(zip(given.doc_id, given.text, given.source)), 10)
    assert {(r[0], r[8]) for r in judged if r[9]} == set(zip(got.doc_id, got.text))
    assert list(got.columns) == corpus_pipeline.COLUMNS


def test_a_large_source_loses_its_boilerplate(spark):
    """30 of 12,000 documents of a source share a line."""
    text = F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(22)))
    text = F.when(F.col("id") < 30, F.concat(text, F.lit("\nshared line"))).otherwise(text)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length(text).cast("long").alias("n_chars"))
    got = corpus_pipeline.quality_rules(spark, docs, ROOT)
    assert [r["doc_id"] for r in got.where("text LIKE '%shared line'").collect()] == [0] and got.count() == 12_000


def test_language(stages):
    given, got = stages["language_id"]
    lang = dict(zip(given.doc_id, given.lang))
    same = sum(lang[i] == x for i, x in zip(got.doc_id, got.lang))
    assert same > 0.97 * len(got) and len(got) > 0.97 * len(given) and set(got.text) <= set(given.text)
    assert any(re.search(r"[^\W\d_]", t) for t in got.text)


def test_texts_of_no_learned_language_go(spark):
    """Long texts in another language or of random letters go, and those of the learned languages stay."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select(corpus_pipeline.COLUMNS)
    random.seed(3)
    salad = [" ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(80)) for _ in range(5)]
    hungarian = "a kormány tegnap elfogadta azt a törvényjavaslatot amely szerint minden gyermek ingyenes étkezést kaphat az iskolában "
    odd = spark.createDataFrame([(10**9 + k, t, None, "s", len(t)) for k, t in enumerate([*salad, hungarian * 2])], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(odd), ROOT).select("doc_id").collect()}
    assert max(got) < 10**9
    clean = {r["doc_id"] for r in docs.collect()}
    assert len(got) >= 0.97 * len(clean)


def test_nothing_is_lost_where_nothing_can_be_learned(spark):
    """Documents without labels stay; so do those of a language for which no labelled text is found right."""
    names = "doc_id long, text string, lang string, source string, n_chars long, fit double"
    rows = [(i, f"plain english words number {i} and a few more of them", None, "s", 9, 0.0) for i in range(5)]
    bare = spark.createDataFrame(rows, names)
    assert sorted(corpus_pipeline.language_id(spark, bare, ROOT).collect()) == sorted(bare.drop("fit").collect())
    docs = spark.createDataFrame([*rows, (7, "plain english words", "en", "s", 9, 0.0), (8, "12 34", "en", "s", 9, 0.0)], names)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, ROOT).collect()}
    assert got == dict.fromkeys([0, 1, 2, 3, 4, 7], "en")


def test_near_dedup(stages):
    given, got = stages["near_dedup"]
    kept = {i for i, (_, _, k) in brute_components(list(zip(given.doc_id, given.text))).items() if k}
    assert kept == set(got.doc_id) and len(kept) < len(given)


def test_decontamination(spark, stages):
    given, got = stages["benchmark_decontamination"]
    bench = spark.read.parquet(f"{ROOT}/benchmark.parquet").toPandas()
    hits = brute_hits(list(zip(given.doc_id, given.text)), list(zip(bench.item_id, bench.text)))
    assert {i for i, _, n, _ in hits if not n} == set(got.doc_id) and len(got) < len(given)


def test_packing(stages):
    from test_token_operators import check_packing, plain
    from tokenizers import Tokenizer

    given, got = stages["packing"]
    own = plain(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), list(given.text))
    check_packing(got.to_dict("records"), list(zip(given.doc_id, own)), 2048, 1)


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
        assert docs.count() == 0


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, ROOT)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
