"""Pseudo-labelling operators on DataFrames.

All of them are projections/filters over ``model.transform`` output, so a
scoring pass plus the confidence filter is a single map-only stage; nothing
is collected and re-parallelised.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seedgrow.functions.labels import label_of_index
from seedgrow.functions.vectors import max_probability, vector_size


def hide_labels(df: DataFrame, id_col: str = "row_id", features_col: str = "features", label_col: str = "label") -> DataFrame:
    """The pool as learners see it: id and features, label null."""
    return df.select(F.col(id_col), F.col(features_col), F.lit(None).cast("double").alias(label_col))


def mark_unlabeled(
    labeled: DataFrame, unlabeled: DataFrame, id_col: str = "row_id", features_col: str = "features", label_col: str = "label"
) -> DataFrame:
    """One input table: labelled rows plus the pool with a null label."""
    keep = [id_col, features_col, label_col]
    return labeled.select(*keep).unionByName(hide_labels(unlabeled, id_col, features_col, label_col))


def mixed_features(
    labeled: DataFrame, unlabeled: DataFrame, id_col: str = "row_id", features_col: str = "features"
) -> DataFrame:
    """Features of every row, labelled or not, labels dropped."""
    return labeled.select(id_col, features_col).unionByName(unlabeled.select(id_col, features_col))


def feature_dims(df: DataFrame, features_col: str = "features") -> DataFrame:
    """``(n_rows, min_dim, max_dim)`` in one aggregate (validating form)."""
    s = vector_size(features_col)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(s).alias("min_dim"),
        F.max(s).alias("max_dim"),
    )


def feature_count(df: DataFrame, features_col: str = "features") -> int:
    """Vector dimension; fails if rows disagree."""
    r = feature_dims(df, features_col).collect()[0]
    if r["n_rows"] == 0:
        raise ValueError("cannot infer the feature dimension of an empty table")
    if r["min_dim"] != r["max_dim"]:
        raise ValueError(f"feature vectors have different sizes ({r['min_dim']}..{r['max_dim']})")
    return int(r["max_dim"])


def no_pushdown(df: DataFrame) -> DataFrame:
    """Keep later filters above this point.

    Catalyst pushes a filter on a model-derived column below the projection
    that computes it, so the model would run once in the filter and again for
    the kept rows. An observation node is not crossed by filter pushdown;
    placed right after scoring, it keeps the model to one evaluation per row.
    (It also counts the rows it sees, at the cost of a per-task counter.)
    """
    return df.observe(Observation(), F.count(F.lit(1)).alias("rows_scored"))


def confidence_filter(scored: DataFrame, threshold: float, probability_col: str = "probability") -> DataFrame:
    """Rows whose largest class probability is strictly above ``threshold``
    (the model behind ``scored`` is evaluated once per row)."""
    return no_pushdown(scored).where(max_probability(probability_col) > F.lit(float(threshold)))


def reliable_pseudo_labels(
    model,
    pool: DataFrame,
    threshold: float,
    labels: Sequence,
    id_col: str = "row_id",
    features_col: str = "features",
    label_col: str = "label",
    scoring_features_col: str | None = None,
    transform: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Score the pool, keep confident rows, emit ``(id, label, features)``.

    The model may score something other than ``features_col`` while the
    output keeps the full vector: either an existing column
    (``scoring_features_col``) or a ``Column -> Column`` ``transform`` of
    the features (e.g. ``lambda c: slice_vector(c, view)``), evaluated as an
    expression during the scan.
    """
    fcol = scoring_features_col or features_col
    if transform is not None:
        pool = pool.withColumn("__scored_features", transform(F.col(features_col)))
        fcol = "__scored_features"
    scored = model.transform(
        pool,
        {
            model.featuresCol: fcol,
            model.predictionCol: "__pred",
            model.probabilityCol: "__prob",
            model.rawPredictionCol: "__raw",
        },
    )
    kept = confidence_filter(scored, threshold, "__prob")
    return kept.select(F.col(id_col), label_of_index("__pred", labels).cast("double").alias(label_col), F.col(features_col))


def pseudo_label_all(
    model,
    pool: DataFrame,
    labels: Sequence,
    id_col: str = "row_id",
    features_col: str = "features",
    label_col: str = "label",
) -> DataFrame:
    """Every pool row with its predicted label, no threshold."""
    scored = model.transform(
        pool,
        {model.featuresCol: features_col, model.predictionCol: "__pred", model.probabilityCol: "__prob", model.rawPredictionCol: "__raw"},
    )
    return scored.select(F.col(id_col), label_of_index("__pred", labels).cast("double").alias(label_col), F.col(features_col))
