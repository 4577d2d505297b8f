"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of other characters than letters becomes one blank, and the n-grams of the
code points are hashed into buckets. Training counts buckets by language in each task and adds the counts up
in Spark; the matrix of log probabilities, whose size is languages times buckets, is broadcast and a batch
of texts is scored at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import tokens, words

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Added to every count.
SMOOTHING = 0.5
#: Largest number of languages, which bounds what is broadcast: 4 bytes for each language and bucket.
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: Least fit of a language: times the distance of the lowest twentieth from the median, and nats an n-gram at least.
FAR, SPARE = 3.0, 1.0
#: Code points handled at once; longer texts are counted in overlapping parts.
PART = 500_000

_LETTERS: np.ndarray | None = None


class Model(NamedTuple):
    """Languages in ascending order and the log probability of each (row) and bucket (column), priors apart."""

    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams and the number of the text of each, in parts of about ``PART`` code points.

    An n-gram is a run of letters of one word, with the blank before or after it at most, so a text cut at a
    blank gives the same n-grams. A word longer than a part is cut where the part ends.
    """
    group: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        text = text.lower()
        a = 0
        while a == 0 or a < len(text):
            b = len(text) if len(text) - a <= PART else text.rfind(" ", a + 1, a + PART)
            b = b if b > a else min(len(text), a + PART)
            group.append((i, text[a:b]))
            held += b - a
            if held >= PART:
                yield _grams_of(group)
                group, held = [], 0
            a = max(b, 1)
    if group:
        yield _grams_of(group)


def _grams_of(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(f" {t} " for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.array([i for i, _ in group]), [len(t) + 2 for _, t in group])
    blank = ~letters()[points]
    # One blank for a run of them, and none between texts: their n-grams end at it anyway.
    keep = np.ones(len(points), bool)
    keep[1:] = ~blank[1:] | ~blank[:-1]
    points, of, blank = np.where(blank, np.uint32(0x20), points)[keep].astype(np.uint64), of[keep], blank[keep]
    blanks = np.cumsum(blank)
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: max(0, len(points) - n + 1)] * words._BASE + points[n - 1 :]
        if n in ORDERS:
            last = len(points) - n + 1
            if n == 1:
                whole = ~blank
            else:
                whole = blanks[n - 2 : len(points) - 1] == blanks[: max(0, last)]
                if n == 2:
                    whole = ~(blank[:-1] & blank[1:])
            buckets.append((words.mix(h[whole] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
            # A shared blank belongs to the text before; the n-gram to that of its letters.
            middle = of[(n - 1) // 2 :][: len(whole)] if n != 2 else np.where(blank[:-1], of[1:], of[:-1])
            owners.append(middle[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(rows: DataFrame) -> Model:
    """Fit on all labelled rows (text, lang).

    Each task returns a row for each language and bucket that it has seen, so at most languages times
    buckets rows; they are added up before the matrix goes to the driver. Rows without text or language are
    passed over.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, row in counts.items():
                at = np.flatnonzero(row)
                of = np.concatenate(([-1], at))
                n = np.concatenate(([docs[lang]], row[at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(of)), pa.array(of, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"]
                )
            counts.clear()
            docs.clear()

        for batch in batches:
            for part in tokens.slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                for x in langs:
                    docs[x] = docs.get(x, 0) + 1
                for buckets, owners in grams(part.column("text").to_pylist()):
                    found = np.bincount(number[owners] * BUCKETS + buckets, minlength=len(names) * BUCKETS)
                    for name, row in zip(names, found.reshape(len(names), BUCKETS)):
                        counts[name] = counts[name] + row if name in counts else row
                if len(counts) > MAX_LANGUAGES:
                    yield from flush()
        yield from flush()

    known = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    sums = known.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Rows of a language come as one value of packed pairs, so the driver gets a row per language.
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("all")).limit(MAX_LANGUAGES + 1)
    table = packed.toArrow()
    if table.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    order = np.argsort(np.array(table.column("lang").to_pylist(), object), kind="stable").tolist()
    languages = [table.column("lang")[i].as_py() for i in order]
    matrix = np.zeros((len(languages), BUCKETS))
    priors = np.zeros(len(languages))
    for row, i in enumerate(order):
        pairs = table.column("all")[i].values
        at, n = pairs.field("bucket").to_numpy(), pairs.field("n").to_numpy()
        priors[row] = n[at < 0].sum()
        matrix[row, at[at >= 0]] = n[at >= 0]
    matrix += SMOOTHING
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True)) if len(languages) else matrix
    return Model(languages, np.log(priors / priors.sum()) if len(languages) else priors, matrix.T.astype(np.float32).copy())


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, the probability of that language under the model, and fit.

    ``fit`` is the mean log probability of the text's n-grams in that language; unlike the score it does not grow with
    the text, so it tells texts of the language from those that are only nearer to it than to the others. Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model knows no
    language. Ties go to the first language in ascending order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, priors, matrix = sent.value
        for batch in batches:
            for part in tokens.slices(batch, "__text"):
                texts = ["" if t is None else t for t in part.column("__text").to_pylist()]
                total = np.zeros((len(texts), len(languages)))
                some = np.zeros(len(texts), bool)
                grams_of = np.zeros(len(texts))
                for buckets, owners in grams(texts):
                    some[owners] = True
                    grams_of += np.bincount(owners, minlength=len(texts))
                    # Each text's buckets with their counts: a sparse row for each text.
                    cells, n = np.unique(owners * BUCKETS + buckets, return_counts=True)
                    of, at = np.divmod(cells, BUCKETS)
                    for k in range(len(languages)):
                        total[:, k] += np.bincount(of, weights=n * matrix[at, k], minlength=len(texts))
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                fit = np.zeros(len(texts))
                if languages:
                    plain = total.copy()
                    total += priors
                    best = total.argmax(axis=1)
                    odds = np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    scores = np.where(some, 1 / odds, 0.0)
                    fit = plain[np.arange(len(texts)), best] / np.maximum(grams_of, 1)
                    names = [languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names), pa.array(scores), pa.array(fit)], [*part.schema.names[:-1], "lang_pred", "score", "fit"]
                )

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(predicted, f"{schema}, lang_pred string, score double, fit double")


def least_fits(found: DataFrame) -> DataFrame:
    """For each language the least fit of a text of it, as (of_lang, least), from predictions with their label ``lang``.

    All labelled texts that the label is found for count. The limit lies as many times ``FAR`` below the median as the
    lowest twentieth does, and ``SPARE`` at least. A language that no labelled text is found for has no limit.
    """
    right = found.where("lang = lang_pred AND score > 0")
    low = right.groupBy(F.col("lang").alias("of_lang")).agg(F.percentile_approx("fit", [0.5, 0.05], 1000).alias("q"))
    return low.select("of_lang", (F.col("q")[0] - F.greatest(FAR * (F.col("q")[0] - F.col("q")[1]), F.lit(SPARE))).alias("least"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents, learned from those that are not held out.

    Only text and label of the rows that are not held out are learned from; rows without either teach nothing. Every row
    gets a prediction: ``und`` with score 0 for a null text, one without a letter, and for all if nothing was learned.
    Ties go to the first language in ascending order, a row without an id is not held out, rows that repeat are learned and
    predicted as often as given, an empty table gives an empty one. Other columns play no part, whatever their names.
    """
    model = train(docs.where(~is_held_out(F.col("doc_id"))).select("text", "lang"))
    found = predict(docs, model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
