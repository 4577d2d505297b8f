"""Near duplicates by a chosen-path similarity join over minwise tokens of word shingles.

Documents with equal shingle sets are one class. The classes descend trees: at a node a few of the minwise
tokens are selected by the node's own hash, and a class goes to a child for each selected token's value, so
classes that agree on a token stay together and two with similarity s share a child of a tree with
probability s at least. Independent trees repeat this until a pair at the threshold is missed by none with
the wanted probability.

First every class is compared with one class of its node (its pivot), which joins groups of copies with as many
comparisons as classes. What is connected then needs no comparison, so a node is judged by its classes outside its
largest component. Nodes with few pairs left emit them; sketches drop those that are far below the threshold and
the others are decided on the full shingle sets. Nodes with more pairs are compared exhaustively on the full sets in
blocks of class against class, each in a task that hands on a spanning forest of its links instead of pairs. Nodes
with very many classes outside branch again, as long as that makes them smaller, with so many children that a pair at
the threshold survives at any depth. Labels are renewed after every level, so what is connected does not branch again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import tokens, words
from siltstone.llm.components import components
from siltstone.session import remove, union_all, work_dir

SHINGLE = 5
#: Link when 100 * |A ∩ B| >= PERCENT * |A ∪ B|.
PERCENT = 75
#: Minwise tokens of a class.
TOKENS = 128
#: Independent trees; a pair at the threshold is missed by all with probability 0.25 ** 16 at the first level.
TREES = 16
#: Pairs up to which a node emits them one by one.
FEW_PAIRS = 4096
#: Classes outside the largest component up to which a node is compared exhaustively in blocks.
SMALL = 1024
#: Levels that large nodes branch at a time. A node selects one token or two, one and a half on average: a pair at the
#: threshold has 9/8 common children, so of the 22 roots all lose it with probability 0.04 % at most, however deep they go.
STEP = 2
#: A step should halve a node. One that is this many times larger than its root halved at each step is not branched again.
BEHIND = 4
#: Classes on each side of a block when a node is compared, and their shingles altogether.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Pairs in a block that share a shingle, from which that shingle is counted by a matrix product.
DENSE = 2_000
#: Sketch estimates below the threshold by more than this are dropped (over five standard errors).
SLACK = 0.2
#: Ids of documents to compare that are sent to every executor (8 bytes each); more are joined with the texts by a shuffle.
SENT_IDS = 1_000_000
#: Parts of a group of equal sets when its class is handed back to its documents.
SALTS = 16

_MULTIPLY = np.random.default_rng(7).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. A text of fewer words is one shingle, one without words none."""
    found, at = words.hashed(texts, words.BLANKS)
    runs = words.windows(found, SHINGLE)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        else:
            out.append(words.windows(found[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in tokens.slices(batch, "text"):
            sets = shingles(rows.column("text"))
            sizes = np.array([len(s) for s in sets], np.int64)
            some = sizes > 0
            first, second = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            sketch = np.zeros((len(sets), TOKENS), np.uint32)
            if some.any():
                flat = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[some]
                first[some] = np.add.reduceat(words.mix(flat), starts).view(np.int64)
                second[some] = np.add.reduceat(words.mix(flat ^ _OTHER), starts).view(np.int64)
                for k in range(TOKENS):
                    sketch[some, k] = np.minimum.reduceat((flat * _MULTIPLY[k]) >> np.uint64(32), starts)
            columns = [pa.array(sizes), pa.array(first), pa.array(second), pa.array([s.tobytes() for s in sketch], pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", "n", "h1", "h2", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in tokens.slices(batch, "text"):
            sets = shingles(rows.column("text"))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            flat = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), column], ["doc_id", "elements"])


def _root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of every tree's root that a class goes to: one selected token, or two in every third tree."""
    picks = [(t, j) for t in range(TREES) for j in ((2 * t, 2 * t + 1) if t % 3 == 0 else (2 * t,))]
    seeds = words.mix(np.array([t * TOKENS + j + 1 for t, j in picks], np.uint64))
    for batch in batches:
        if batch.num_rows:
            sketch = _matrix(batch.column("sketch"))
            nodes = words.mix(sketch[:, [j for _, j in picks]].astype(np.uint64) * words._BASE + seeds)
            of = np.repeat(np.arange(batch.num_rows), len(picks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.reshape(-1).view(np.int64)), batch.column("class_id").take(pa.array(of))], ["node", "class_id"]
            )


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The descendants of other nodes ``STEP`` levels down: at each the node's hash selects one token, or two with probability a half.

    A row is a class with its sketch and all its nodes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = _matrix(batch.column("sketch"))
        nodes = batch.column("nodes")
        rows = np.repeat(np.arange(batch.num_rows), nodes.value_lengths().to_numpy())
        inner = nodes.flatten()
        node, was = inner.field("node").to_numpy().view(np.uint64), inner.field("was").to_numpy()
        for _ in range(STEP):
            second = words.mix(node ^ _OTHER) % np.uint64(2) == 0
            drawn = np.concatenate((words.mix(node + np.uint64(1)), words.mix(node[second] + np.uint64(2))))
            rows, was = np.concatenate((rows, rows[second])), np.concatenate((was, was[second]))
            j = (drawn % np.uint64(TOKENS)).astype(np.int64)
            node = words.mix(drawn * words._BASE + sketch[rows, j].astype(np.uint64))
        of = batch.column("class_id").take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), of, pa.array(was)], ["node", "class_id", "was"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Elements that each set of the left side shares with each of the right one; the sets are distinct numbers."""
    counts = np.zeros((len(left), len(right)), np.float32)
    of = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate([np.empty(0, np.int64), *side]) for side in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if not len(both):
        return counts
    held = []
    for values, rows in zip(flat, of):
        at = np.searchsorted(both, values)
        here = both[np.minimum(at, len(both) - 1)] == values
        order = np.argsort(at[here], kind="stable")
        held.append((at[here][order], rows[here][order]))
    sizes = [np.bincount(at, minlength=len(both)) for at, _ in held]
    dense = sizes[0] * sizes[1] > DENSE
    # Shingles that many sets hold: products of 0/1 matrices, some shingles at a time.
    place = np.cumsum(dense) - 1
    for k in range(0, int(dense.sum()), 4096):
        sides = []
        for (at, rows), side in zip(held, (left, right)):
            wanted = dense[at] & (place[at] >= k) & (place[at] < k + 4096)
            hold = np.zeros((len(side), min(4096, int(dense.sum()) - k)), np.float32)
            hold[rows[wanted], place[at[wanted]] - k] = 1
            sides.append(hold)
        counts += sides[0] @ sides[1].T
    # The others: the pairs that hold each.
    (at, rows), (at_right, rows_right) = ((a[~dense[a]], r[~dense[a]]) for a, r in held)
    starts = np.searchsorted(at_right, at)
    n = sizes[1][at]
    for a in range(0, len(at), 65_536):
        few = n[a : a + 65_536]
        inner = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)
        pairs = np.repeat(rows[a : a + 65_536], few) * len(right) + rows_right[np.repeat(starts[a : a + 65_536], few) + inner]
        counts += np.bincount(pairs, minlength=counts.size).reshape(counts.shape)
    return counts


def _forest(a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray) -> list[int]:
    """Places of links (a, b) that connect the same components as all of them do."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    kept = []
    _, first = np.unique(np.stack((label_a, label_b)), axis=1, return_index=True)
    for k in first.tolist():
        x, y = root(int(label_a[k])), root(int(label_b[k]))
        if x != y:
            above[x] = y
            kept.append(k)
    return kept


def _block_links(rows: pa.Table) -> pa.Table:
    """Of one block of a node (classes outside its main component against others): a spanning forest of the links between components."""
    few, others = (rows.filter(pc.equal(rows.column("side"), v)).combine_chunks() for v in (0, 1))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not few.num_rows or not others.num_rows:
        return out.empty_table()
    sets, ids, labels = ([t.column(c).to_numpy() for t in (few, others)] for c in ("elements", "class_id", "label"))
    sizes = [np.array([len(s) for s in side]) for side in sets]
    both = shared_counts(*(list(side) for side in sets))
    near = 100 * both >= PERCENT * (sizes[0][:, None] + sizes[1][None] - both)
    i, j = np.nonzero(near & (labels[0][:, None] != labels[1][None]))
    kept = _forest(i, j, labels[0][i], labels[1][j])
    a, b = ids[0][i[kept]], ids[1][j[kept]]
    return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree on enough tokens."""
    for batch in batches:
        if batch.num_rows:
            same = (_matrix(batch.column("sketch_a")) == _matrix(batch.column("sketch_b"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= (PERCENT / 100 - SLACK) * TOKENS))


class _Join:
    """The tables of one run in its work folder."""

    def __init__(self, spark: SparkSession, docs: DataFrame, folder: str):
        self.spark, self.folder, self.steps = spark, folder, 0
        self.at: dict[int, str] = {}
        self.docs = docs
        self.sketches = self.keep(docs.mapInArrow(_sketched, "doc_id long, n long, h1 long, h2 long, sketch binary"))
        named = self.sketches.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = self.keep(
            named.groupBy("h1", "h2", "n").agg(
                F.min("doc_id").alias("class_id"), F.count("*").alias("members"), F.first("sketch").alias("sketch")
            )
        )

    def keep(self, df: DataFrame, *used: DataFrame) -> DataFrame:
        """The rows as a written table, so that later steps neither repeat nor depend on how they were made.

        Tables of this run that were ``used`` for the last time are deleted once the rows are written.
        """
        self.steps += 1
        at = f"{self.folder}/{self.steps}"
        df.write.parquet(at)
        for table in used:
            remove(self.spark, self.at.pop(id(table)))
        kept = self.spark.read.parquet(at)
        self.at[id(kept)] = at
        return kept

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those whose full shingle sets are similar enough."""
        of = self.classes.select("class_id", "n", "sketch")
        a, b = (of.select(*(F.col(c).alias(f"{c}_{x}") for c in of.columns)) for x in "ab")
        near = (
            pairs.distinct()
            .join(a, F.col("a") == F.col("class_id_a"))
            .join(b, F.col("b") == F.col("class_id_b"))
            .where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
            .select("a", "b", "sketch_a", "sketch_b")
        )
        likely = self.keep(near.mapInArrow(_likely, "a long, b long"))
        sets = self.sets(likely.select(F.col("a").alias("c")).union(likely.select("b")))
        left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("of_a"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("of_b"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        enough = 100 * both >= PERCENT * (F.size("of_a") + F.size("of_b") - both)
        return self.keep(likely.join(left, "a").join(right, "b").where(enough).select("a", "b"), likely, sets)

    def sets(self, classes: DataFrame) -> DataFrame:
        """The shingle sets (doc_id, elements) of classes, read from the documents that name them."""
        wanted = self.keep(classes.toDF("c").distinct())
        few = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted
        sets = self.docs.join(few, F.col("doc_id") == F.col("c"), "left_semi").mapInArrow(_sets, "doc_id long, elements array<long>")
        return self.keep(sets, wanted)

    def labelled(self, rows: DataFrame, labels: DataFrame | None, *more: str) -> DataFrame:
        """Node rows with the component known so far."""
        if labels is None:
            return rows.withColumn("label", F.col("class_id"))
        known = rows.join(labels, F.col("class_id") == F.col("node_"), "left")
        return known.select("node", "class_id", F.coalesce("label", "class_id").alias("label"), *more)

    def shared(self, rows: DataFrame) -> DataFrame:
        """Rows (node, class_id) of the nodes that hold more than one class."""
        nodes = rows.groupBy(F.col("node").alias("of")).agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi")
        return self.keep(rows.join(nodes, F.col("node") == F.col("of"), "left_semi"))

    def stars(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Pairs of each class with its node's pivot where they are not yet connected.

        The pivot is the smallest class at first, which groups of copies share in most of their nodes; once
        components are known it is drawn by hash, so that a class meets another one in every node.
        """
        known = self.labelled(rows, labels)
        rank = F.col("class_id") if labels is None else F.xxhash64("node", "class_id")
        pivots = known.groupBy(F.col("node").alias("of")).agg(
            F.min(F.struct(rank, F.col("class_id").alias("p"), F.col("label").alias("pl"))).alias("x")
        )
        met = known.join(pivots, F.col("node") == F.col("of")).where(F.col("label") != F.col("x.pl"))
        return met.select(F.least("class_id", "x.p").alias("a"), F.greatest("class_id", "x.p").alias("b"))

    def open(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the nodes whose classes are not all connected: with their label, the node's largest one and the number outside it."""
        known = self.labelled(rows, labels, "was")
        parts = known.groupBy("node", "label").agg(F.count("*").alias("n"))
        nodes = parts.groupBy(F.col("node").alias("of")).agg(
            F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")
        ).where("top.n < all")
        return self.keep(
            known.join(nodes, F.col("node") == F.col("of")).select(
                "node", "class_id", "label", "was", F.col("top.label").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("outside")
            )
        )

    def pairs(self, rows: DataFrame) -> DataFrame:
        """All unconnected pairs of nodes with few: each class outside the main component with all others."""
        few = rows.where("label != main").select("node", F.col("class_id").alias("x"), F.col("label").alias("lx"))
        met = few.join(rows, "node").where(
            (F.col("lx") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("x") < F.col("class_id")))
        )
        return met.select(F.least("x", "class_id").alias("a"), F.greatest("x", "class_id").alias("b"))

    def blocks(self, rows: DataFrame) -> DataFrame:
        """The classes outside the main component (side 0) and all classes (side 1) of nodes, dealt to blocks (node, i, j).

        Both sides of a node are dealt to parts of about ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles, and each part
        of one side meets each of the other in a block of its own.
        """
        sized = rows.join(self.classes.select(F.col("class_id").alias("c"), "n"), F.col("class_id") == F.col("c")).drop("c")
        outside = F.sum(F.when(F.col("label") != F.col("main"), F.col("n")))
        heavy = sized.groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("n_all"), outside.alias("n_outside"))
        parts = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(f"n_{c}") / BLOCK_SHINGLES)).cast("int")
        part = lambda c: F.pmod(F.xxhash64("class_id"), parts(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
        dealt = rows.join(heavy, F.col("node") == F.col("of"))
        few = dealt.where("label != main").select("node", part("outside").alias("i"), each("all").alias("j"), F.lit(0).alias("side"), "class_id", "label")
        others = dealt.select("node", each("outside").alias("i"), part("all").alias("j"), F.lit(1).alias("side"), "class_id", "label")
        return few.union(others)

    def compared(self, rows: DataFrame) -> DataFrame:
        """Links of nodes, enough to connect what all their links connect."""
        sets = self.sets(rows.select("class_id"))
        wide = self.blocks(rows).join(sets, F.col("class_id") == F.col("doc_id")).select("node", "i", "j", "side", "class_id", "label", "elements")
        return self.keep(wide.groupBy("node", "i", "j").applyInArrow(_block_links, "a long, b long").distinct(), sets)

    def labels(self, links: list[DataFrame]) -> DataFrame:
        self.steps += 1
        found = components(self.spark, union_all(links), f"{self.folder}/components-{self.steps}")
        return found.select(F.col("node").alias("node_"), "label")


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept.

    Component ids are exact for the links found; every link found is exact. Texts without words have 0
    shingles and are linked with nothing. A row without an id takes no part: its component is null and it is
    kept. Rows that repeat an id count as one document with several texts.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    run = _Join(spark, rows, work_dir(spark, "near-duplicates"))
    sketches = run.classes.select("class_id", "sketch")
    nodes = run.shared(run.keep(sketches.mapInArrow(_root, "node long, class_id long")))
    links, labels = [], None
    for _ in range(2):
        links.append(run.verified(run.stars(nodes, labels)))
        labels = run.labels(links)
    nodes = nodes.withColumn("was", F.lit(None).cast("long"))
    for step in count():
        unsettled = run.open(nodes, labels)
        was = F.coalesce("was", "outside")
        large = (F.col("outside") > SMALL) & (F.col("outside") * F.lit(2.0**step) <= BEHIND * was)
        some = F.col("outside") * F.col("all") <= FEW_PAIRS
        found = [run.verified(run.pairs(unsettled.where(~large & some)))]
        many = unsettled.where(~large & ~some)
        if not many.isEmpty():
            found.append(run.compared(many))
        found = [f for f in found if not f.isEmpty()]
        links += found
        if found:
            labels = run.labels(links)
        again = unsettled.where(large).select("node", "class_id", was.alias("was"))
        if again.isEmpty():
            break
        listed = again.groupBy(F.col("class_id").alias("c")).agg(F.collect_list(F.struct("node", "was")).alias("nodes"))
        wide = listed.join(sketches, F.col("class_id") == F.col("c")).select("class_id", "sketch", "nodes")
        nodes = run.keep(wide.mapInArrow(_branch, "node long, class_id long, was long").distinct(), unsettled)
    return _by_document(run, labels)


def _by_document(run: _Join, labels: DataFrame) -> DataFrame:
    """Components of the classes handed back to the documents; only sets held more than once meet at a join, in salted parts."""
    copies = run.classes.where("members > 1").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n").alias("cn"), "class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    )
    own = run.sketches.select("doc_id", "n", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    same = (
        (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n") == F.col("cn"))
        & (F.col("salt") == F.col("s")) & F.col("doc_id").isNotNull()
    )
    # A class alone is its own; classes with links are looked up by their id, which no more documents share than hold the set.
    classed = own.join(copies, same, "left").withColumn("class", F.coalesce("class_id", "doc_id"))
    linked = labels.select(
        F.col("node_").alias("l"), "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("ls")
    )
    whole = classed.join(linked, (F.col("class") == F.col("l")) & (F.col("salt") == F.col("ls")), "left")
    component = F.coalesce("label", "class")
    return whole.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("class").alias("class_id"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
