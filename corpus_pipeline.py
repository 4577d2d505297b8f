"""The corpus pipeline: quality rules, language, near duplicates, benchmark passages, packing.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and works on everything its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, language, line_rules, near_duplicates, packing
from siltstone.session import pin, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less certain than this is rejected.
MIN_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of their source share.

    A null text has no words and goes; rows without a source are a source of their own, those without an id one document.
    Repeated rows are judged alike. An empty table stays empty, and columns other than those of documents are left out.
    """
    judged = line_rules.apply_rules(docs.select(COLUMNS)).where("kept")
    changed = ~F.col("clean_text").eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose n-grams fit a language that the model knows, with the language that it finds.

    Null texts and texts without a letter go. Where no document has a text and a label, nothing is learned and all documents
    stay as they are; a language that no labelled text is found for has no limit of its fit. Repeated rows are judged
    alike. An empty table stays empty, and columns other than those of documents are left out.
    """
    docs = docs.select(COLUMNS)
    model = language.train(docs.where(~language.is_held_out(F.col("doc_id"))).select("text", "lang"))
    if not model.languages:
        return docs
    # Scored once: the limits come from the same predictions.
    at = work_dir(spark, "languages")
    language.predict(docs, model, keep=tuple(COLUMNS)).write.parquet(at)
    found = spark.read.parquet(at)
    # One row a language.
    least = pin(language.least_fits(found))
    known = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    fitting = known.join(least, F.col("lang_pred") == F.col("of_lang"), "left").where("least IS NULL OR fit >= least")
    return fitting.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of near duplicates; of rows that repeat an id all or none."""
    docs = docs.select(COLUMNS)
    gone = near_duplicates.near_duplicates(spark, docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item.

    A null text has no words and stays; rows that repeat an id go together if one of them is hit. An empty table stays
    empty, and columns other than those of documents are left out.
    """
    docs = docs.select(COLUMNS)
    found = decontaminate.find(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.decontaminated(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in sequences of 2048 tokens.

    A null text is empty: its document is the end token alone. Each row is a document, also if it repeats an id. An empty
    table gives no sequence, and other columns play no part.
    """
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Language scores and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written as Parquet and read by the next."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
