"""Token ids, counts, files and packing against the tokenizers library used plainly."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import packing, token_counts, token_files, tokens, word_packing
from siltstone.session import work_dir

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
TRICKY = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na\n\n", "don't I'LL we've 'tis", "x1y22 3,4",
    "<|endoftext|>", "a<|endoftext|>b <| c", "<|startoftext|> x", "Straße Éa çà Ñ ÀÉ", "ﬁ Σίσυφος ΟΔΟΣ", "日本語 テスト",
    "é è ́x", "a b c \u0085", "tab\tand\rreturn\r\n", "\x1c\x1d x", "🙂🙂 ok", "İstanbul ıI",
    "a" * 5000, "word " * 3000, "!!! %%% &&&*** $$$ ###", "nul\x00byte", "×÷ µ º",
]
ROWS = "doc_id long, text string, n_tokens string, rank int"


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def both(request):
    return tokens.Encoder(request.param), Tokenizer.from_file(request.param)


def plain(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_tricky_texts(both):
    ids, counts = both[0].encode(pa.array(TRICKY, pa.string()))
    assert split(ids, counts) == plain(both[1], TRICKY)
    assert both[0].counts(pa.array(TRICKY, pa.string())).tolist() == counts.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ é'sß\n\t 19.,<|ñ ́Σ語"), max_size=40), min_size=1, max_size=8))
def test_any_texts(both, texts):
    ids, counts = both[0].encode(pa.array(texts, pa.string()))
    assert split(ids, counts) == plain(both[1], texts)
    assert both[0].counts(pa.array(texts, pa.string())).tolist() == counts.tolist()


def test_long_texts_are_cut_safely(both, monkeypatch):
    monkeypatch.setattr(tokens, "LONG_BYTES", 40)
    texts = ["Éa word's 12 more, and <|endoftext|> then some  words 語 here " * 20, "x" * 300]
    ids, counts = both[0]._by_library(texts)
    assert len(tokens.cut(texts[0])) > 10 and split(ids, counts) == plain(both[1], texts)


def test_batches_hold_all_and_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 100)
    sizes = [5, 300, 60, 60, 1, 0, 99]
    found = list(tokens.balanced(sizes))
    assert sorted(sum(found, [])) == list(range(7)) and all(len(b) == 1 or sum(sizes[k] for k in b) <= 100 for b in found)


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], ROWS)


def test_counts(spark):
    texts = [*TRICKY, "same", "same"]
    got = token_counts.count_tokens(frame(spark, texts), BYTES)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = plain(Tokenizer.from_file(BYTES), texts)
    assert Counter(map(tuple, got.collect())) == Counter(
        (i if i != 3 else None, len((t or "").encode()), len(w)) for i, (t, w) in enumerate(zip(texts, want))
    )
    assert token_counts.count_tokens(frame(spark, []), BYTES).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=300))
def test_words_round_trip(values):
    given_ = np.array(values, np.uint64)
    words, escaped = word_packing.pack(given_)
    assert np.array_equal(word_packing.unpack(words, escaped, len(values)), given_)
    assert len(escaped) == sum(v >= 2**60 for v in values)


def test_zeros_fill_words():
    words, _ = word_packing.pack(np.zeros(600, np.uint64))
    assert len(words) == 10


def brute_files(texts, ids, end):
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
    out, at = [], 0
    for i, own in zip(order, plain(Tokenizer.from_file(WORDS), [texts[i] for i in order])):
        own = own + [end]
        out.append((ids[i], at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    return out


def test_token_files(spark, monkeypatch):
    texts = [t for t in TRICKY if t is None or "\x00" not in t] + ["twice", "twice"]
    ids = [7 * i % 31 for i in range(len(texts) - 1)] + [0]
    ids[5] = None
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = token_files.round_trip(spark, docs, WORDS, 2)
    assert Counter(map(tuple, got.collect())) == Counter(brute_files(texts, ids, 2))
    assert token_files.round_trip(spark, docs.limit(0), WORDS, 2).count() == 0


def test_token_ids_come_back(spark):
    docs = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    manifest = token_files.write_ids(spark, docs, WORDS, 2, work_dir(spark, "ids"))
    got = {r["doc_id"]: r["ids"] for r in token_files.read_ids(manifest, with_ids=True).collect()}
    assert got == {i + 1: own + [2] for i, own in enumerate(plain(Tokenizer.from_file(WORDS), ["a", "b c"]))}


def test_broken_token_file(tmp_path):
    at = tmp_path / "x"
    with at.open("wb") as f:
        token_files.write_file(f, np.array([1]), np.array([False]), np.array([3]), np.array([5, 6, 2], np.uint32))
    with pa.OSFile(str(at)) as f:
        table, docs, nulls, counts = token_files.read_index(f)
        assert token_files.read_block(f, table[0]).tolist() == [5, 6, 2] and counts.tolist() == [3]
    at.write_bytes(at.read_bytes()[:-1])
    with pa.OSFile(str(at)) as f, pytest.raises(ValueError):
        token_files.read_index(f)


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {16: 3}, {9: 10}, {1: 100}, {16: 2, 9: 5, 7: 5, 3: 40}])
def test_patterns_place_every_length(histogram):
    used = Counter()
    for n, pack in packing.patterns(histogram, 16):
        assert n > 0 and sum(pack) <= 16
        for length in pack:
            used[length] += n
    assert used == histogram


def test_patterns_of_random_lengths_fill_well():
    r = random.Random(3)
    histogram = Counter(r.randint(1, 2048) for _ in range(50_000))
    packs = packing.patterns(histogram, 2048)
    total = sum(k * n for k, n in histogram.items())
    assert total / 2048 / sum(n for n, _ in packs) > 0.98 and len(packs) < 3 * 2048


def check_packing(rows, docs, capacity, end):
    want = Counter()
    for i, own in docs:
        own = own + [end]
        for a in range(0, len(own), capacity):
            piece = own[a : a + capacity]
            want[(i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(own))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing(spark):
    texts = [*TRICKY, *["one two three"] * 40, *["x y " * k for k in range(60)]]
    texts = [t for t in texts if t is None or "\x00" not in t]
    docs = frame(spark, texts).repartition(3)
    got = packing.pack_documents(spark, docs, WORDS, end_id=1, capacity=32).collect()
    own = plain(Tokenizer.from_file(WORDS), texts)
    check_packing(got, [(i if i != 3 else None, x) for i, x in enumerate(own)], 32, 1)
    assert packing.pack_documents(spark, docs.limit(0), WORDS).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, "a b c d " * k) for k in range(12)], "doc_id long, text string")
    placed = packing.pack_documents(spark, docs, WORDS, capacity=16, with_ids=True)
    got = packing.assemble(placed).collect()
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in got]
    assert all(len(x) == r["n_tokens"] <= 16 for x, r in zip(ids, got))
    want = Counter(i for x in plain(Tokenizer.from_file(WORDS), ["a b c d " * k for k in range(12)]) for i in x + [1])
    assert Counter(sum(ids, [])) == want


def test_a_length_of_most_pieces_is_dealt_to_many_tasks(spark):
    """The full pieces are numbered in as many buckets as the root of their number, each once."""
    pieces = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") < 18_000, 2048).otherwise(F.col("id") % 7 + 1).cast("long").alias("length"), (F.col("id") * 3).alias("ids_crc32"),
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = packing.with_rank(pieces, histogram)
    for length, n in histogram.items():
        assert sorted(r["rank"] for r in ranked.where(F.col("length") == length).select("rank").collect()) == list(range(n))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and plan.count("Window [row_number") <= 2
    dealt = pieces.where("length = 2048").groupBy(F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(135))).count()
    assert dealt.count() == 135 and dealt.agg(F.max("count")).first()[0] < 2 * 135


def test_a_repeated_id_is_dealt_to_many_tasks(spark, tmp_path):
    """Rows that share an id lie in several files, in order of their texts, and come back whole."""
    texts = [f"{k:05d} some words" for k in range(4000)]
    docs = spark.createDataFrame([(7, t, 1) for t in texts] + [(7, None, 1), (None, "x", 1)], "doc_id long, text string, start int")
    # Small ranges are put together again otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_ids(spark, docs.repartition(5), WORDS, 2, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.where("n_docs > 0").count() >= 3
    got = token_files.read_ids(manifest).orderBy("start").collect()
    assert len(got) == 4002 and got[0]["doc_id"] is None and {r["doc_id"] for r in got[1:]} == {7}
    library = Tokenizer.from_file(WORDS)
    order = ["x", "", *sorted(texts)]
    assert [r["n_tokens"] for r in got] == [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in order]


def test_counts_are_lengths(both):
    encoder, library = both
    texts = ["", None, "plain words and words", "it's a\n\ntest  of 12 numbers", "é à", "日本語 text", "<|endoftext|> x", "w" * 300_000, "long text " * 20_000]
    plain_counts = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for _ in range(2):
        assert encoder.counts(pa.array(texts)).tolist() == plain_counts
