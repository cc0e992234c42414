"""Vector column expressions.

Everything here is a Catalyst expression over ``pyspark.ml`` vectors: no
Python worker is involved, so the expressions fuse into the scan's
whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _to_array(c: Column) -> Column:
    # ``vector_to_array`` raises on a null vector; keep nulls null.
    return F.when(c.isNotNull(), vector_to_array(c))


def as_array(c: str | Column) -> Column:
    """Vector -> ``array<double>`` (dense values, whatever the storage)."""
    return _to_array(_col(c))


def dense(c: str | Column) -> Column:
    """Normalise any vector to dense storage.

    Set operations compare the stored form, so a sparse and a dense vector
    with equal values would otherwise be different keys.
    """
    return array_to_vector(_to_array(_col(c)))


def vector_size(c: str | Column) -> Column:
    """Dimension of a vector (``bigint``)."""
    return F.size(_to_array(_col(c))).cast("long")


def slice_vector(c: str | Column, indices: Sequence[int]) -> Column:
    """Feature view: pick positions ``indices`` (any order, repeats allowed).

    ``VectorSlicer`` rejects repeated indices, so the general form is an
    array expression. Indices are validated against the dimension by the
    caller (``operators.pseudo.feature_count``).
    """
    idx = [int(i) for i in indices]
    if not idx:
        raise ValueError("a feature view needs at least one index")
    if min(idx) < 0:
        raise ValueError(f"negative feature index in view {idx}")
    c = _col(c)
    arr = vector_to_array(c)
    return F.when(c.isNotNull(), array_to_vector(F.array(*[arr.getItem(i) for i in idx])))


def max_probability(c: str | Column) -> Column:
    """Confidence of a scored row: the largest class probability."""
    return F.array_max(_to_array(_col(c)))


def probability_at(c: str | Column, index: int) -> Column:
    """Probability of the class with internal index ``index``."""
    return _to_array(_col(c)).getItem(int(index))


DIGEST = ["__d1", "__d2"]


def vector_digest(arr: Column) -> list[Column]:
    """A 128-bit digest of an ``array<double>`` as two longs, ``DIGEST``: 16
    bytes that stand for the vector as a shuffle key. Equal vectors have equal
    digests (-0.0 counts as 0.0); the reverse is checked where it is used."""
    plain = F.transform(arr, lambda x: x + F.lit(0.0))
    return [F.xxhash64(F.lit(seed), plain).alias(name) for seed, name in enumerate(DIGEST, 1)]


def one_vector(low: Column, high: Column) -> Column:
    """``low``, the only vector of its digest; the job fails where two
    different vectors share one (``low`` and ``high`` are the extremes)."""
    return F.when(low.eqNullSafe(high), low).otherwise(F.raise_error(F.lit("two vectors share a 128-bit digest")))


def same_vector(a: Column, b: Column) -> Column:
    """Equality of two arrays that the planner does not take for a join key."""
    return (a <= b) & (a >= b)
