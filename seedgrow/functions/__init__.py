"""Column expressions (JVM-side, codegen-friendly) used by every operator."""

from seedgrow.functions.vectors import (
    as_array,
    dense,
    max_probability,
    probability_at,
    slice_vector,
    vector_size,
)
from seedgrow.functions.hashing import unit_hash
from seedgrow.functions.labels import index_of_label, label_of_index

__all__ = [
    "as_array",
    "dense",
    "max_probability",
    "probability_at",
    "slice_vector",
    "vector_size",
    "unit_hash",
    "index_of_label",
    "label_of_index",
]
