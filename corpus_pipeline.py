"""Corpus pipeline: language, near duplicates, personal data, mixture, tokens.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedgrow.llm import bpe, jaccard_join, langid, mixing, pii
from seedgrow.llm.common import Scratch, read_table
from seedgrow.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null text, no letter, or no n-gram
    of any profile. The profiles are learned from the training rows of the
    stage's own input; ``lang`` becomes the predicted language."""
    ensure_checkpoint_dir(spark)
    profiles = langid.train(docs.where(~langid.held_out()))
    d = langid.predict(docs.select(*COLUMNS), profiles)
    d = d.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0))
    return d.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays;
    of rows repeating that id, one. Rows without an id stay only where no row
    of their group has one, and then one of them."""
    ensure_checkpoint_dir(spark)
    return jaccard_join.first_of_each(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in angle brackets."""
    ensure_checkpoint_dir(spark)
    d = pii.redact(docs.select(*COLUMNS))
    n = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return d.withColumn("n_chars", n).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to meet the sources' target weights."""
    ensure_checkpoint_dir(spark)
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per emitted document: its id, number of tokens and digests."""
    ensure_checkpoint_dir(spark)
    return bpe.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

# Language profiles, weak supervision and BPE have no SQL form; the tests hold
# every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    ensure_checkpoint_dir(spark)
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, "stage")
    return docs
