"""Label indexing (string-indexer semantics) without leaving the JVM.

The label domain is found with one distributed ``groupBy(label).count()``.
Index order is descending frequency, ties broken by the label's string form
ascending — the order ``StringIndexer`` uses. As a table (``label_index_table``)
the dictionary may have any size and is joined in both directions
(``with_label_index``, ``with_label``). A learner needs the list of its classes on
the driver, where its parameters for each class are too (``frequency_labels``;
``max_classes`` guards against an id-like label column).
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.operators.prefix import positions

if TYPE_CHECKING:  # plans import this module
    from seedgrow.plans.lineage import Workspace

DEFAULT_MAX_CLASSES = 10_000


def label_counts(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, n)`` over labelled rows, in index order (not collected)."""
    lab = F.col(label_col)
    return (
        df.where(lab.isNotNull())
        .groupBy(lab.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("label").cast("string").asc())
    )


def frequency_labels(df: DataFrame, label_col: str, max_classes: int = DEFAULT_MAX_CLASSES) -> list:
    """Labels in index order. Raises if the domain exceeds ``max_classes``
    (a guard against indexing a continuous or id-like column)."""
    rows = label_counts(df, label_col).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"label column {label_col!r} has more than {max_classes} distinct values")
    return [r["label"] for r in rows]


def resolve_labels(df: DataFrame, label_col: str, max_classes: int = DEFAULT_MAX_CLASSES) -> tuple[list, bool]:
    """Label list for a learner and whether it is the identity mapping.

    Labels that already are the class indices ``0.0 .. k-1`` keep their
    positions (so ``probability[i]`` is P(label i), as for any Spark
    classifier); any other domain (``-1/+1``, gaps) is indexed by frequency.
    """
    labels = frequency_labels(df, label_col, max_classes)
    try:
        as_float = sorted(float(v) for v in labels)
    except (TypeError, ValueError):
        return labels, False
    if as_float == [float(i) for i in range(len(labels))]:
        return as_float, True
    return labels, False


def label_index_table(df: DataFrame, label_col: str, ws: Workspace | None = None) -> DataFrame:
    """``(label, label_index, n)``: the fitted index as a table, of any size.

    Positions are found over ordered ranges of the per-class counts
    (``prefix.positions``), so no task holds all labels and none pass through
    the driver. The written table stays in ``ws``, or until it is released.
    """
    from seedgrow.plans.lineage import Workspace

    lab = F.col(label_col)
    counts = df.where(lab.isNotNull()).groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("__text", F.col("label").cast("string"))
    ws = ws or Workspace(df.sparkSession, "labels", keep=True)
    placed = positions(counts, ws, "labels", ["n", "__text"], ["n"], "label_index")
    placed = placed.select("label", F.col("label_index").cast("double").alias("label_index"), "n")
    ws.write(placed, "dictionary")
    return ws.read("dictionary", placed.schema)


def with_label_index(df: DataFrame, dictionary: DataFrame, label_col: str, out: str = "label_index") -> DataFrame:
    """``df`` with the class index of its label (null for null and unknown
    labels). The planner broadcasts the dictionary where its written size allows
    it; a hot label is then no hot key, and otherwise the adaptive planner splits it."""
    d = dictionary.select(F.col("label").alias("__label"), F.col("label_index").alias("__index"))
    j = df.join(d, df[label_col] == d["__label"], "left")
    return j.withColumn(out, F.col("__index")).drop("__label", "__index")


def with_label(df: DataFrame, dictionary: DataFrame, index_col: str, out: str = "label") -> DataFrame:
    """``df`` with the label of its class index (null for null and unknown)."""
    d = dictionary.select(F.col("label").alias("__label"), F.col("label_index").alias("__index"))
    j = df.join(d, df[index_col] == d["__index"], "left")
    return j.withColumn(out, F.col("__label")).drop("__label", "__index")
