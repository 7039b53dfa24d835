"""A corpus pipeline over ``documents``: each stage reads what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.llm.bpe import encode_decode
from agewise.llm.common import held_out, materialise, table
from agewise.llm.lines import dedup_lines
from agewise.llm.mixing import mix_sources
from agewise.llm.quality import document_statistics, fit_discriminant, score_quality
from agewise.llm.simhash import drop_near_copies

#: A document goes if the classifier's score is lower.
LEAST_QUALITY = 0.5
#: Rows that travel to and from a Python worker at a time; texts are long, so fewer than Spark's default of 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Spark reads the setting when a stage's result is written, so it stays for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones among them, doesn't reject.

    Null and empty texts are scored like any other; without labels nothing is rejected; repeated rows and null ids stay. An
    empty table gives no rows.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = document_statistics(docs).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    scored = score_quality(docs, fit_discriminant(known, stat_col="x"), score_col="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without the lines that ten documents or more share; n_chars follows.

    A null text becomes empty; a text that loses all its lines is empty and stays; every row counts as a document.
    """
    found = dedup_lines(docs)
    own = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return found.select(*(own[c].alias(c) if c in own else F.col(c) for c in docs.columns))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more.

    Texts without words, null ones among them, are copies of each other; a class keeps the row of its least id, and one with a
    null id only if it has no other.
    """
    small_batches(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to half as often again. A null source is a source of its own."""
    return mix_sources(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and of decoded bytes, a row for each row of the mixture; a null text counts as empty."""
    small_batches(spark)
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash),
    ("mixing", mixing),
    ("byte BPE", encoding),
]

#: The classifier and the merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
