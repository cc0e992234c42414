"""Adapters from the given parquet tables to the engine's sample schema.

Sample schema: ``row_id bigint, features vector (dense), label double``
with ``label`` null for unlabelled rows. Every adapter is a projection (and
at most one equi-join on a unique key), so Catalyst prunes the scan to the
columns it needs. Text features are counted batch by batch in Arrow; the rest
stays in one codegen stage.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The alphabet whose letter frequencies form the document
# features (lower-case ASCII a..z, in order).
LETTERS = string.ascii_lowercase


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _letter_shares(text):
    """Share of each letter in the characters of each UTF-8 text. No letter is
    a byte of another character, and every character has one byte that is no
    continuation byte. Null and empty texts hold none."""
    import pyarrow as pa

    shares = np.zeros((len(text), len(LETTERS)))
    if len(text):
        _, offsets, data = text.buffers()
        wide = np.int64 if pa.types.is_large_binary(text.type) else np.int32
        at = np.frombuffer(offsets, wide)[text.offset : text.offset + len(text) + 1].tolist()
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        first, last = ord(LETTERS[0]), ord(LETTERS[-1]) + 1
        for i in np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False)).tolist():
            if at[i] < at[i + 1]:
                counts = np.bincount(data[at[i] : at[i + 1]], minlength=256)
                shares[i] = counts[first:last] / (counts.sum() - counts[0x80:0xC0].sum())
    every = pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(LETTERS))
    return pa.ListArray.from_arrays(every, pa.array(shares.ravel()))


def letter_frequencies(text: str | Column) -> Column:
    """26 letter frequencies of ``lower(text)`` over the whole text.

    ``(length(t) - length(replace(t, c, ''))) / length(t)``, all letters
    counted in one pass over the text; empty or null text gives all zeros.
    """
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return array_to_vector(F.arrow_udf(_letter_shares, "array<double>")(t.cast("binary")))


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as fully labelled samples (float array -> double vector)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
    )


def binary_embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary +1/-1 form of ``embeddings`` (even class ids are positive)."""
    s = embedding_samples(spark, sf_dir)
    return s.withColumn("label", F.when(F.col("label") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with letter-frequency features; ``label`` keeps ``lang``
    as a string (index it with ``operators.indexing.label_index``)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"),
        letter_frequencies("text").alias("features"),
        F.col("lang").alias("label"),
    )


def quality_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` left-joined to ``labels``: ``label`` = quality, null
    where no label row exists (the genuinely partially labelled form).

    Both sides are keyed by the unique ``doc_id``: a plain equi-join, no
    skew; AQE turns it into a broadcast only if the label side proves small
    at runtime.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"),
        letter_frequencies("text").alias("features"),
        F.col("quality").cast("double").alias("label"),
    )


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines ``label,f1 f2 f3`` built from integer ``part`` columns,
    with malformed lines injected by a rule on ``p_type`` and the last word
    of ``p_name``.

    Features are ``p_size``, ``length(p_name)`` and ``p_partkey``; the label
    is 1 when ``p_size > 25`` else -1. Injected faults (whole-table rules,
    no row is dropped): ECONOMY gear loses its comma, ECONOMY bolt gets a
    blank field, PROMO ring gets letters in a number, SMALL rod gets a
    trailing space (accepted), LARGE bolt gets a letter label, STANDARD
    anvil has nothing after the comma.
    """
    p = read_table(spark, sf_dir, "part")
    lab = F.when(F.col("p_size") > 25, F.lit("1")).otherwise(F.lit("-1"))
    f1 = F.col("p_size").cast("string")
    f2 = F.length("p_name").cast("string")
    f3 = F.col("p_partkey").cast("string")
    t, n = F.col("p_type"), F.col("p_name")
    sp, cm = F.lit(" "), F.lit(",")
    line = (
        F.when((t == "ECONOMY") & n.like("%gear"), F.concat_ws(" ", lab, f1, f2, f3))
        .when((t == "ECONOMY") & n.like("%bolt"), F.concat(lab, cm, f1, F.lit("  "), f2, sp, f3))
        .when((t == "PROMO") & n.like("%ring"), F.concat(lab, cm, F.lit("x"), f1, sp, f2, sp, f3))
        .when((t == "SMALL") & n.like("%rod"), F.concat(lab, cm, f1, sp, f2, sp, f3, sp))
        .when((t == "LARGE") & n.like("%bolt"), F.concat(F.lit("y"), cm, f1, sp, f2, sp, f3))
        .when((t == "STANDARD") & n.like("%anvil"), F.concat(lab, cm))
        .otherwise(F.concat(lab, cm, f1, sp, f2, sp, f3))
    )
    return p.select(line.alias("value"))
