"""Label <-> class-index expressions over a fitted model's label list.

The list has one entry per class of a learner, whose parameters for each class
are on the driver anyway. It is embedded as one literal, folded once, whatever
its length; tables of labels beyond a learner's classes are joined instead
(``operators.indexing``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def index_of_label(c: str | Column, labels: Sequence) -> Column:
    """Original label -> double class index; null (unlabelled) stays null."""
    if not labels:
        raise ValueError("empty label list")
    keys = _array(labels)
    indices = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: i.cast("double"))
    return F.element_at(F.map_from_arrays(keys, indices), _col(c))


def label_of_index(c: str | Column, labels: Sequence) -> Column:
    """Class index (double) -> original label."""
    if not labels:
        raise ValueError("empty label list")
    # Guarded: a null position into an array without nulls is not null by itself.
    return F.when(_col(c).isNotNull(), F.element_at(_array(labels), _col(c).cast("int") + F.lit(1)))


def _array(labels: Sequence) -> Column:
    """The list as one foldable expression (a JSON literal, parsed once)."""
    kind = "string" if isinstance(labels[0], str) else "double" if isinstance(labels[0], float) else None
    if kind is None or (kind == "double" and not all(math.isfinite(v) for v in labels)):
        return F.array(*[F.lit(v) for v in labels])
    return F.from_json(F.lit(json.dumps(list(labels))), f"array<{kind}>")
