"""Quality rules: text measures and the frequency of lines across the documents of a host.

DataFrame functions only. A document's lines are normalised (lower case, words joined by one blank) and
hashed; a line's frequency is the number of distinct documents of the host that hold it. A line above the limit is
removed everywhere but in the document with the host's smallest id among its bearers, so of equal documents beyond
the limit one keeps its lines; a document that keeps too little of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 8

#: A line is removed when more documents of the host than this hold it.
MAX_DOCS = 10
#: A document is depleted when fewer words than this share of it remain.
MIN_KEPT = 0.5


def words_of(text: Column) -> Column:
    """The words between blanks (space and the five ASCII control blanks); null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, also where ``then`` uses it inside a lambda."""
    return F.transform(F.array(value), then)[0]


def with_measures(docs: DataFrame, text: str = "text", *more: Column) -> DataFrame:
    """Adds ``more`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. Null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select("*", *more).withColumn("__words", words_of(F.col(text)))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("__lines", F.transform(lines, lambda x: F.xxhash64(x)))
    last = (F.col("n_words") - WINDOW).cast("int")
    windows = let(
        F.transform("__words", lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        ),
    )
    out = out.withColumn("__windows", F.when(last >= 0, windows).otherwise(F.array().cast("array<bigint>")))
    out = out.select(
        *docs.select("*", *more).columns,
        "n_words",
        F.length(F.regexp_replace(whole, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.lit(0))
        .otherwise(_covered("__windows"))
        .cast("long")
        .alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _covered(windows: str) -> Column:
    """Words inside windows that occur twice or more: sort the windows, keep those equal to a neighbour, join their spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))

    def repeated(x):
        return F.transform(
            x,
            lambda v, k: F.when((F.get(x, k - 1)["h"] == v["h"]) | (F.get(x, k + 1)["h"] == v["h"]), v["i"]),
        )

    indexed = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        F.sort_array(F.array_compact(let(indexed, repeated))),
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )


def lines_of(text: Column) -> Column:
    """The lines of a text, normalised: lower case, words joined by one blank; a line without words is empty."""
    flat = F.regexp_replace(F.lower(text), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def with_lines(docs: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    """Every line with a word of every document: host, document, content hash, the line's place, hash and words."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    lines = F.transform(
        lines_of(F.col(text)),
        lambda x, k: F.when(x != "", F.struct(k.alias("place"), F.xxhash64(x).alias("line"), words(x).alias("words"))),
    )
    rows = docs.select(
        F.col(host).alias("__host"), F.col(doc_id).alias("__doc"), F.xxhash64(text).alias("__content"), F.explode(F.array_compact(lines)).alias("__at")
    )
    return rows.select("__host", "__doc", "__content", F.col("__at.place").alias("__place"), F.col("__at.line").alias("__line"), F.col("__at.words").alias("__n"))


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """Lines above the limit of their host, with the smallest id of a document that holds them.

    The first grouping holds a line once for each document, so a line that a third of all rows hold is
    spread over its documents before it is counted; the second combines before it shuffles. Rows without an id
    count as one document.
    """
    once = lines.groupBy("__host", "__line", "__doc").agg(F.lit(1).alias("__one"))
    counted = once.groupBy("__host", "__line").agg(F.count("*").alias("__docs"), F.min("__doc").alias("__first"))
    return counted.where(F.col("__docs") > max_docs).select("__host", "__line", "__first")


def removed_lines(docs: DataFrame, doc_id: str, host: str, text: str, max_docs: int) -> DataFrame:
    """For each document (id and content) with lines to remove: the hashes of those lines and the words that go.

    Of a line in a hot group only (host, line) meets at the join; its side is salted, the other repeated.
    """
    salts = 16
    lines = with_lines(docs, doc_id, host, text)
    often = frequent_lines(lines, max_docs).select(
        F.col("__host").alias("__h"), F.col("__line").alias("__l"), "__first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s")
    )
    salted = lines.withColumn("__salt", F.pmod(F.xxhash64("__doc", "__content"), F.lit(salts)).cast("int"))
    hit = salted.join(
        often, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__line") == F.col("__l")) & (F.col("__salt") == F.col("__s"))
    ).where(~F.col("__doc").eqNullSafe(F.col("__first")))
    # Repeated rows hold the same lines at the same places, which count once.
    places = F.collect_set(F.struct("__place", F.col("__n").alias("n")))
    return hit.groupBy("__doc", F.col("__content").alias("__of")).agg(
        F.collect_set("__line").alias("__remove"), F.aggregate(places, F.lit(0), lambda a, p: a + p["n"]).alias("__gone")
    )


def apply_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_docs: int = MAX_DOCS,
    min_kept: float = MIN_KEPT,
) -> DataFrame:
    """All rows and columns with the measures, ``n_removed_words``, ``clean_text`` and ``kept``.

    Null text or host: a null text has no words and fails; rows without a host form a host of their own.
    Repeated rows are kept and judged alike. Columns of the result replace input columns of the same name.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "clean_text", "kept"]
    docs = docs.drop(*own)
    gone = removed_lines(docs, doc_id, host, text, max_docs)
    # The hash is a column of its own, so that the text crosses the join only if the clean text is asked for.
    measured = with_measures(docs, text, F.xxhash64(text).alias("__content"))
    judged = measured.join(gone, F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.col("__content") == F.col("__of")), "left")
    pairs = F.arrays_zip(F.split(F.col(text), "\n").alias("raw"), lines_of(F.col(text)).alias("flat"))
    left = F.filter(pairs, lambda x: ~F.array_contains("__remove", F.xxhash64(x["flat"])))
    clean = F.when(F.col("__remove").isNull(), F.col(text)).otherwise(F.array_join(left["raw"], "\n"))
    removed = F.coalesce("__gone", F.lit(0))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_kept * F.col("n_words"))
    return (
        judged.withColumn("clean_text", clean)
        .withColumn("n_removed_words", removed.cast("long"))
        .withColumn("kept", kept)
        .select(*docs.columns, *own)
    )
