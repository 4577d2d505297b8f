"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment holds a bounded number of whole training documents and, for each
term of the benchmark (or every term), the sorted list of the term's places in the segment. A window of
test words is found by intersecting its terms' lists, each shifted by the term's offset in the window, from
the term that is rarest in the whole corpus to the most frequent, and stops as soon as nothing is left.
All lists of a segment lie together, so a search moves the few test windows to the segments and no posting.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import tokens, words
from siltstone.session import union_all, work_dir

#: Consecutive words of a test item that must stand in a document.
WINDOW = 10
#: Distinct test terms up to which the index holds their lists only; beyond it holds every term's.
MAX_TERMS = 500_000
#: Test windows sent to the tasks at once; more are searched in several passes over the index.
MAX_WINDOWS = 50_000

SEGMENT = (
    "segment string, doc_ids array<long>, starts array<int>, terms array<long>, begins array<int>, counts array<int>, places array<int>"
)


def test_windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (item_id, terms) of the test items; an item with fewer words is one window, one with none has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                hashes, at = words.hashed(rows.column("text"), words.NOT_LETTERS)
                items, found = [], []
                for item, a, b in zip(rows.column("item_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = hashes[a:b].view(np.int64)
                    for k in range(max(1, b - a - size + 1) if b > a else 0):
                        items.append(item)
                        found.append(own[k : k + size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["item_id", "terms"]
                )

    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "item_id string, terms array<long>").distinct()


def index(docs: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """Segments of the documents (doc_id, text), one for each run of about ``tokens.SLICE_BYTES`` of text.

    ``terms`` are the segment's terms in ascending order; those of term t are ``places[begins[t] : begins[t] +
    counts[t]]``, in ascending order, counted in words from the segment's first. ``starts`` has each document's
    first place and, at its end, the segment's number of words.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                found, at = words.hashed(rows.column("text"), words.NOT_LETTERS)
                places = np.arange(len(found), dtype=np.int32)
                if terms is not None and len(terms):
                    slot = np.searchsorted(terms, found)
                    slot[slot == len(terms)] = 0
                    hit = terms[slot] == found
                    found, places = found[hit], places[hit]
                elif terms is not None:
                    found, places = found[:0], places[:0]
                order = np.argsort(found, kind="stable")
                found, places = found[order], places[order]
                begins = np.flatnonzero(np.concatenate((found[:1] == found[:1], found[1:] != found[:-1])))
                counts = np.diff(np.append(begins, len(found)))
                lists = [
                    pa.array([uuid.uuid4().hex]),
                    _one(rows.column("doc_id"), pa.int64()),
                    _one(at, pa.int32()),
                    _one(found[begins].view(np.int64), pa.int64()),
                    _one(begins, pa.int32()),
                    _one(counts, pa.int32()),
                    _one(places, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(lists, ["segment", "doc_ids", "starts", "terms", "begins", "counts", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(build, SEGMENT)


def _one(values, kind: pa.DataType) -> pa.Array:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values).cast(kind))


def term_counts(segments: DataFrame) -> DataFrame:
    """How often each indexed term stands in the corpus, combined in each task before the shuffle."""
    pairs = F.explode(F.arrays_zip("terms", "counts"))
    return segments.select(pairs.alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n"))


def matches_in(segment: dict, terms: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows (numbers) and the places of their first words in a segment.

    ``terms[bounds[w]:bounds[w+1]]`` are window w's terms from the rarest on and ``offsets`` their places in it.
    With ``slop`` a term may stand up to so many words from its place relative to the rarest term.
    """
    where = np.searchsorted(segment["terms"], terms)
    where[where == len(segment["terms"])] = 0
    present = segment["terms"][where] == terms if len(segment["terms"]) else np.zeros(len(terms), bool)
    # Only windows of which every term stands in the segment are looked at.
    whole = np.flatnonzero(np.add.reduceat(~present, bounds[:-1]) == 0) if len(bounds) > 1 else []
    numbers, starts = [], []
    for w in whole:
        at = None
        for k in range(bounds[w], bounds[w + 1]):
            b = segment["begins"][where[k]]
            listed = segment["places"][b : b + segment["counts"][where[k]]] - offsets[k]
            if at is None:
                at = listed
            else:
                near = np.searchsorted(listed, at - slop)
                near[near == len(listed)] = len(listed) - 1
                at = at[np.abs(listed[near] - at) <= slop]
            if not len(at):
                break
        if len(at):
            numbers.append(np.full(len(at), w))
            starts.append(at)
    if not numbers:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(numbers), np.concatenate(starts).astype(np.int64)


def search(segments: DataFrame, windows: list[tuple[str, list[int]]], counts: dict[int, int], slop: int = 0) -> DataFrame:
    """For every document of the index: its place in it, doc_id, n_words, spans (from, to) of hit words and items.

    ``windows`` are (item_id, terms); at most ``MAX_WINDOWS`` of them, so that what is sent to the tasks is
    bounded. Spans are merged and relative to the document's first word; a match never reaches across documents.
    """
    if len(windows) > MAX_WINDOWS:
        raise ValueError("search the windows in several passes")
    terms, offsets, bounds = [], [], [0]
    for _, own in windows:
        order = sorted(range(len(own)), key=lambda k: (counts.get(own[k], 0), k))
        terms += [own[k] for k in order]
        offsets += order
        bounds.append(len(terms))
    sent = segments.sparkSession.sparkContext.broadcast(
        (
            [w[0] for w in windows],
            np.array(terms, np.int64).view(np.uint64),
            np.array(offsets, np.int64),
            np.array(bounds, np.int64),
            np.array([len(w[1]) for w in windows], np.int64),
        )
    )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, offsets, bounds, lengths = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                seg = {
                    n: batch.column(n)[k].values.to_numpy(zero_copy_only=False)
                    for n in ("starts", "terms", "begins", "counts", "places")
                }
                seg["terms"] = seg["terms"].view(np.uint64)
                docs = batch.column("doc_ids")[k].values
                starts = seg["starts"].astype(np.int64)
                w, at = matches_in(seg, terms, offsets, bounds, slop)
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = (at >= 0) & (doc < len(docs))
                inside[inside] &= at[inside] + lengths[w[inside]] <= starts[doc[inside] + 1]
                w, at, doc = w[inside], at[inside], doc[inside]
                by_doc: dict[int, list] = {}
                for d, i, a in zip(doc.tolist(), w.tolist(), at.tolist()):
                    by_doc.setdefault(d, []).append((a - int(starts[d]), i))
                spans: list = [[]] * len(docs)
                names: list = [[]] * len(docs)
                for d, hits in by_doc.items():
                    spans[d] = merged((a, a + int(lengths[i])) for a, i in sorted(hits))
                    names[d] = sorted({items[i] for _, i in hits})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("segment").take(pa.array(np.full(len(docs), k))),
                        pa.array(np.arange(len(docs), dtype=np.int64)),
                        docs.cast(pa.int64()),
                        pa.array(np.diff(starts)),
                        pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    ["segment", "nth", "doc_id", "n_words", "spans", "items"],
                )

    schema = "segment string, nth long, doc_id long, n_words long, spans array<struct<`from`:long,`to`:long>>, items array<string>"
    return segments.mapInArrow(found, schema)


def merged(spans) -> list[dict]:
    """Spans in ascending order joined where they touch."""
    out: list[dict] = []
    for a, b in spans:
        if out and a <= out[-1]["to"]:
            out[-1]["to"] = max(out[-1]["to"], b)
        else:
            out.append({"from": a, "to": b})
    return out


def find(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    slop: int = 0,
    max_terms: int = MAX_TERMS,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_words, n_hit (words inside any occurrence), spans and items.

    Exact phrases with ``slop`` 0, else proximity matches. The index and the test windows are written to the
    shared work folder first. Null texts and empty tables have no words and no windows; rows that repeat an id
    are documents of their own. The windows are searched in as many passes as ``max_windows`` asks for, each
    over the whole index, and their spans are then joined by document.
    """
    folder = work_dir(spark, "term-index")
    test_windows(benchmark, size).write.parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows")
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    terms = None
    if vocabulary.count() <= max_terms:
        terms = np.sort(np.array([r[0] for r in vocabulary.collect()], np.int64).view(np.uint64))
    index(docs, terms).write.parquet(f"{folder}/segments")
    segments = spark.read.parquet(f"{folder}/segments")
    frequency = term_counts(segments)
    n = windows.count()
    # Twice as many passes as would just hold them, since they are dealt by hash.
    passes = 1 if n <= max_windows else -(-2 * n // max_windows)
    found = []
    for k in range(passes):
        part = windows.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == k)
        own = part.select(F.explode("terms").alias("term")).distinct()
        counts = {r["term"]: r["n"] for r in frequency.join(own, "term").collect()}
        rows = part.collect()
        found.append(search(segments, [(r["item_id"], r["terms"]) for r in rows], counts, slop))
    if passes > 1:
        whole = union_all(found).groupBy("segment", "nth").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    else:
        whole = found[0]
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["to"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return whole.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def decontaminated(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """The documents without a hit; rows that repeat an id (null is one) go together."""
    hit = matches.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")), "left_anti")
