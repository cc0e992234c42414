"""Set operations of the pseudo-labelling loops.

Two matching modes:

* ``features`` — set semantics on the feature vector, as in the original
  (``except``/``intersect`` on vectors). Both sides are reduced with a
  ``groupBy`` first: its map-side partial aggregation collapses a hot
  vector (one value holding a third of the rows) before the shuffle, so the
  following anti/semi join sees distinct keys only. Shuffle keys are 128-bit
  digests of the vectors; the vectors themselves are compared inside equal
  digests, so the result is exact.
* ``id`` — anti/semi joins on the 8-byte row id; unique keys, no skew.

Vectors are compared as ``array<double>`` of their dense values, so a
sparse and a dense copy of the same values match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.functions.vectors import DIGEST, as_array, one_vector, same_vector, vector_digest


def grow_labeled(labeled: DataFrame, accepted: DataFrame) -> DataFrame:
    """Bag union of the labelled table and newly accepted rows."""
    return labeled.unionByName(accepted.select(*labeled.columns))


def mix_labeled_predicted(labeled: DataFrame, predicted: DataFrame) -> DataFrame:
    """Labelled rows plus *all* pseudo-labelled pool rows (EM's M-step input)."""
    return labeled.unionByName(predicted.select(*labeled.columns))


def distinct_vectors(df: DataFrame, id_col: str = "row_id", features_col: str = "features", keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, __d1, __d2, vec, rep_id)``: one row per distinct vector (and
    ``keys``), represented by its smallest id. The vector's digest is the shuffle
    key; partial aggregation makes duplicates cheap."""
    vec = as_array(features_col)
    rows = df.select(*keys, *vector_digest(vec), vec.alias("vec"), F.col(id_col).alias("__id") if id_col in df.columns else F.lit(None).alias("__id"))
    g = rows.groupBy(*keys, *DIGEST).agg(F.min("vec").alias("vec"), F.max("vec").alias("__high"), F.min("__id").alias("rep_id"))
    return g.select(*keys, *DIGEST, one_vector(F.col("vec"), F.col("__high")).alias("vec"), "rep_id")


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join of distinct vectors on their digests; the vectors
    are compared only inside equal digests."""
    on = same_vector(left["vec"], right["vec"])
    for k in [*keys, *DIGEST]:
        on = on & (left[k] == right[k])
    return left.join(right, on, how)


def pool_except(
    pool: DataFrame, accepted: DataFrame, id_col: str = "row_id", features_col: str = "features"
) -> DataFrame:
    """``pool EXCEPT accepted.features`` with distinct semantics.

    Returns ``(row_id, features)`` of the surviving distinct vectors, each
    represented by its smallest id.
    """
    kept = _matched(distinct_vectors(pool, id_col, features_col), distinct_vectors(accepted, id_col, features_col), (), "left_anti")
    return kept.select(F.col("rep_id").alias(id_col), array_to_vector("vec").alias(features_col))


def pool_anti_by_id(pool: DataFrame, accepted: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Pool rows whose id was not accepted (``id`` mode)."""
    return pool.join(accepted.select(id_col), id_col, "left_anti")


def cross_teach(
    labeled1: DataFrame,
    labeled2: DataFrame,
    pool1: DataFrame,
    pool2: DataFrame,
    accepted1: DataFrame,
    accepted2: DataFrame,
    id_col: str = "row_id",
    features_col: str = "features",
    match: str = "features",
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One co-training exchange: each learner's labelled table receives the
    *other* learner's accepted rows; each pool loses its *own* accepted rows."""
    new_l1 = grow_labeled(labeled1, accepted2)
    new_l2 = grow_labeled(labeled2, accepted1)
    if match == "features":
        new_u1 = pool_except(pool1, accepted1, id_col, features_col)
        new_u2 = pool_except(pool2, accepted2, id_col, features_col)
    else:
        new_u1 = pool_anti_by_id(pool1, accepted1, id_col)
        new_u2 = pool_anti_by_id(pool2, accepted2, id_col)
    return new_l1, new_l2, new_u1, new_u2


def agreement(
    labeled1: DataFrame,
    labeled2: DataFrame,
    id_col: str = "row_id",
    features_col: str = "features",
    label_col: str = "label",
    match: str = "features",
) -> DataFrame:
    """Rows present in both grown labelled tables with the same label.

    ``features`` mode: distinct ``(label, vector)`` pairs (``INTERSECT``);
    output ``(label, features)``. ``id`` mode: ``(id, label)`` semi join;
    output ``(id, label, features)``.
    """
    if match == "features":
        a = distinct_vectors(labeled1, id_col, features_col, [label_col])
        b = distinct_vectors(labeled2, id_col, features_col, [label_col])
        both = _matched(a, b, [label_col], "left_semi")
        return both.select(F.col(label_col), array_to_vector("vec").alias(features_col))
    a = labeled1.select(id_col, label_col, features_col).dropDuplicates([id_col, label_col])
    b = labeled2.select(id_col, label_col).distinct()
    return a.join(b, [id_col, label_col], "left_semi")
