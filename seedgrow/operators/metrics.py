"""Evaluation metrics as DataFrame aggregates.

* confusion counts: ``groupBy(label, prediction).count()`` (map-side
  combined, k^2 rows out);
* weighted precision / recall / F1: aggregates over the confusion table,
  with the semantics of Spark's multiclass metrics (classes are the true
  labels; precision of a never-predicted class is 0);
* exact AUC (rank-sum with mean ranks for ties) and the ROC curve.

AUC and ROC need, for every distinct score, the counts of positives and
negatives with a smaller score: ``groupBy(score)`` collapses ties (partial
aggregation), and ``prefix.running_sums`` adds up the distinct scores in two
levels. Every step is distributed and the result is exact.

``metrics_by`` gives all metrics of many models at once: their scores stand in
one long table, and every step above is grouped by the model's columns, so the
number of jobs does not depend on the number of models.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.operators.prefix import running_sums

if TYPE_CHECKING:  # plans import this module
    from seedgrow.plans.lineage import Workspace


def confusion_counts(
    df: DataFrame, label_col: str = "label", prediction_col: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(
        *by, F.col(label_col).cast("double").alias("label"), F.col(prediction_col).cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(
    df: DataFrame, label_col: str = "label", prediction_col: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """``(label, n_true, tp, n_pred)`` per class seen as a label or a prediction.

    Each confusion cell feeds two classes (its label and its prediction), so
    one ``explode`` + ``groupBy`` over the k^2 cells gives every count — no
    join, hence no filter the optimizer could infer and push below the
    (possibly expensive) prediction column.
    """
    cm = confusion_counts(df, label_col, prediction_col, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    roles = F.explode(
        F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("t"), hit.alias("tp"), F.lit(0).cast("long").alias("p")),
            F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("p")),
        )
    ).alias("r")
    return (
        cm.select(*by, roles)
        .groupBy(*by, F.col("r.cls").alias("label"))
        .agg(F.sum("r.t").alias("n_true"), F.sum("r.tp").alias("tp"), F.sum("r.p").alias("n_pred"))
    )


def weighted_metrics(
    df: DataFrame, label_col: str = "label", prediction_col: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """One row (a group of ``by``): ``weighted_precision, weighted_recall, weighted_f1, accuracy, n``.

    Classes are the true labels (a class only ever predicted has weight 0);
    the precision of a class never predicted is 0.
    """
    pc = per_class_counts(df, label_col, prediction_col, by)
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    recall = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0))
    pc = pc.select(*by, "n_true", "tp", precision.alias("p"), recall.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    total = F.sum("n_true")
    return pc.groupBy(*by).agg(
        (F.sum(F.col("p") * F.col("n_true")) / total).alias("weighted_precision"),
        (F.sum(F.col("r") * F.col("n_true")) / total).alias("weighted_recall"),
        (F.sum(f1 * F.col("n_true")) / total).alias("weighted_f1"),
        (F.sum("tp") / total).alias("accuracy"),
        total.cast("long").alias("n"),
    )


def _score_groups(df: DataFrame, label_col: str, score_col: str, positive, by: Sequence[str] = ()) -> DataFrame:
    """``(score, pos, neg)`` per distinct score. Rows with a null label or a
    null or NaN score count as neither (conditional sums rather than a
    filter, which the optimizer would push below the scoring projection)."""
    score = F.col(score_col).cast("double")
    score = F.when(~F.isnan(score), score)
    valid = score.isNotNull() & F.col(label_col).isNotNull()
    is_pos = F.col(label_col) == F.lit(positive)
    return df.groupBy(*by, score.alias("score")).agg(
        F.sum(F.when(valid & is_pos, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(valid & ~is_pos, 1).otherwise(0)).cast("long").alias("neg"),
    )


def score_prefix_counts(
    df: DataFrame,
    label_col: str = "label",
    score_col: str = "score",
    positive=1.0,
    buckets: int | None = None,
    by: Sequence[str] = (),
    ws: Workspace | None = None,
) -> DataFrame:
    """Per distinct score (of each group of ``by``): ``score, pos, neg,
    pos_below, neg_below, pos_total, neg_total`` where ``*_below`` count rows with
    a strictly smaller score.

    ``buckets`` fixes the number of ranges, for tests. The caller's rows are
    evaluated once; the written scores stay in ``ws``, or
    in a workspace of their own until it is released (``lineage.release``).
    """
    from seedgrow.plans.lineage import Workspace

    g = _score_groups(df, label_col, score_col, positive, by)
    ws = ws or Workspace(df.sparkSession, "scores", keep=True)
    c = running_sums(g, ws, "scores", ["score"], ["pos", "neg"], by, (), buckets)
    return c.withColumnsRenamed({"pos_before": "pos_below", "neg_before": "neg_below"})


def auc(
    df: DataFrame, label_col: str = "label", score_col: str = "score", positive=1.0, buckets: int | None = None,
    by: Sequence[str] = (), ws: Workspace | None = None,
) -> DataFrame:
    """One row (a group of ``by``): ``(auc, auc_folded, n_pos, n_neg)``; ``auc``
    is null when a class is missing. ``auc_folded = max(auc, 1 - auc)`` is the
    original's report."""
    c = score_prefix_counts(df, label_col, score_col, positive, buckets, by, ws)
    s = c.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    a = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg")))
    return s.select(
        *by,
        a.alias("auc"),
        F.greatest(a, 1 - a).alias("auc_folded"),
        F.coalesce(F.col("n_pos"), F.lit(0)).cast("long").alias("n_pos"),
        F.coalesce(F.col("n_neg"), F.lit(0)).cast("long").alias("n_neg"),
    )


def metrics_by(df: DataFrame, by: Sequence[str], ws: Workspace, positive=1.0) -> DataFrame:
    """Weighted metrics and AUC of every group of ``by`` over a table ``(*by,
    label, prediction, score)``, in one grouped job each."""
    w = weighted_metrics(df, "label", "prediction", by)
    a = auc(df, "label", "score", positive, None, by, ws)
    on = F.lit(True)
    for k in by:
        on = on & w[k].eqNullSafe(a[k])
    return w.join(a, on, "left").select(
        *[w[k] for k in by], "weighted_precision", "weighted_recall", "weighted_f1", "accuracy", "n", "auc", "auc_folded", "n_pos", "n_neg"
    )


def roc_curve(
    df: DataFrame, label_col: str = "label", score_col: str = "score", positive=1.0, buckets: int | None = None
) -> DataFrame:
    """ROC points ``(threshold, fpr, tpr)``: one per distinct score (rows
    with score >= threshold predicted positive), plus the end points (0, 0)
    and (1, 1) with a null threshold. The rate over an absent class is null."""
    c = score_prefix_counts(df, label_col, score_col, positive, buckets)
    # Above the windows, so this filter stays where it is.
    c = c.where(F.col("pos") + F.col("neg") > 0)
    pts = c.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_total") - F.col("neg_below"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_total") - F.col("pos_below"), F.col("pos_total")).alias("tpr"),
    )
    # The two constant end points (a 2-row range, not a pass over the data).
    ends = df.sparkSession.range(2).select(
        F.lit(None).cast("double").alias("threshold"),
        F.col("id").cast("double").alias("fpr"),
        F.col("id").cast("double").alias("tpr"),
    )
    return pts.unionByName(ends)


def label_residual(prev_col: str, cur_col: str):
    """Aggregate expression: percent of rows whose label changed."""
    changed = (F.col(prev_col) != F.col(cur_col)).cast("double")
    return (F.avg(changed) * 100.0).alias("residual_pct")
