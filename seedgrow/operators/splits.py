"""Labelled / unlabelled holdouts and the labelled-fraction sweep.

Every split is a pure function of (row id, seed, fraction): one projection,
no shuffle, identical after recomputation, nested in the fraction. A
per-row uniform draw is stratified in expectation within every class, as a
per-class random split is, without one pass per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedgrow.functions.hashing import unit_hash


def labeled_flag(id_col: str, fraction: float, seed: int) -> Column:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return unit_hash(id_col, seed) < F.lit(float(fraction))


def stratified_split(
    df: DataFrame, fraction: float, seed: int, id_col: str = "row_id", out_col: str = "is_labeled"
) -> DataFrame:
    """Add ``is_labeled``: True for the labelled part, False for the pool."""
    return df.withColumn(out_col, labeled_flag(id_col, fraction, seed))


def split_tables(
    df: DataFrame, fraction: float, seed: int, id_col: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) views of one table; both are filters of the
    same scan."""
    flag = labeled_flag(id_col, fraction, seed)
    return df.where(flag), df.where(~flag)


def semi_supervised_input(
    df: DataFrame, fraction: float, seed: int, id_col: str = "row_id", label_col: str = "label"
) -> DataFrame:
    """One table, pool labels set to null (the estimators' input form)."""
    return df.withColumn(label_col, F.when(labeled_flag(id_col, fraction, seed), F.col(label_col)))


def holdout_counts(
    df: DataFrame, fraction: float, seeds: Sequence[int], id_col: str = "row_id", label_col: str = "label"
) -> DataFrame:
    """Per (fold, class, is_labeled) row counts for a repeated holdout.

    The fold seeds are exploded into the rows (k x the input, streamed into
    a partial aggregate), so all folds come out of one scan.
    """
    seeds = [int(s) for s in seeds]
    fold = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("fold_seed")
    x = df.select(F.col(id_col), F.col(label_col).alias("label"), fold)
    digest = F.md5(F.concat(F.col("fold_seed").cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    x = x.withColumn("is_labeled", u < F.lit(float(fraction)))
    return x.groupBy("fold_seed", "label", "is_labeled").agg(F.count(F.lit(1)).alias("n"))


# The labelled fractions of the original tool's sweep.
SWEEP_FRACTIONS = (0.120, 0.125, 0.130, 0.135, 0.145, 0.155, 0.165, 0.175, 0.185, 0.195)


def sweep_fractions() -> list[float]:
    """Labelled fractions of the original sweep."""
    return list(SWEEP_FRACTIONS)
