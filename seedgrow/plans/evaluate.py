"""Evaluation harness: holdouts, metrics per algorithm, fraction sweeps, ROC.

For every (labelled fraction, fold seed, algorithm) the harness fits on the
labelled part (semi-supervised estimators also get the pool, labels
hidden), scores the pool once (transductive evaluation, as the original)
and builds the metrics as DataFrame aggregates over the written scores of
all runs, grouped by (name, label_fraction, fold_seed); only the bounded
result table (one row per algorithm and fraction) and the learning times
reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.functions.hashing import unit_hash
from seedgrow.functions.vectors import probability_at
from seedgrow.operators.metrics import metrics_by, roc_curve
from seedgrow.operators.splits import labeled_flag
from seedgrow.plans.base import SemiSupervisedMarker, run_parallel
from seedgrow.plans.lineage import Workspace
from seedgrow.sources.sinks import write_roc

METRICS = ["weighted_precision", "weighted_recall", "weighted_f1", "auc", "auc_folded"]


def _class_of(model, positive) -> int:
    """Position of ``positive`` in a fitted model's probability vector."""
    labels = [float(v) for v in model.labels]
    if float(positive) not in labels:
        raise ValueError(f"positive label {positive} is not among the model's labels {labels}")
    return labels.index(float(positive))


def score_column(model, positive) -> F.Column:
    """Probability of ``positive`` from a fitted model's probability vector."""
    return probability_at(model.getProbabilityCol(), _class_of(model, positive))


def score_models(models: Sequence[tuple[object, str]], rows: DataFrame, label_col: str, positive) -> DataFrame:
    """``(name, label, prediction, score)`` of every row under every fitted
    model: one scan of ``rows`` evaluates all models side by side, then stacks
    one row a model."""
    df = rows.select(F.col(label_col).cast("double").alias("__true"), "*")
    stacked = []
    for i, (model, name) in enumerate(models):
        pred, prob, raw = f"__m{i}_prediction", f"__m{i}_probability", f"__m{i}_raw"
        df = model.transform(df, {model.predictionCol: pred, model.probabilityCol: prob, model.rawPredictionCol: raw})
        score = F.round(probability_at(prob, _class_of(model, positive)), 12)
        stacked.append(F.struct(F.lit(name).alias("name"), F.col(pred).cast("double").alias("prediction"), score.alias("score")))
    rows = df.select(F.col("__true").alias("label"), F.explode(F.array(*stacked)).alias("__m"))
    return rows.select("__m.name", "label", "__m.prediction", "__m.score")


def evaluate_all(
    algorithms: Sequence[tuple[Estimator, str]],
    df: DataFrame,
    fractions: Sequence[float],
    fold_seeds: Sequence[int],
    positive=1.0,
    id_col: str = "row_id",
    label_col: str = "label",
    with_timing: bool = False,
    parallelism: int = 1,
    test_fraction: float | None = None,
) -> DataFrame:
    """Mean metrics over folds per (algorithm, labelled fraction).

    By default the scored rows are the unlabelled pool the semi-supervised
    learners trained on (transductive, as the original). With
    ``test_fraction`` a further hash split of the unlabelled part is held
    out of training altogether and scored instead (inductive).

    Columns: ``name, label_fraction, weighted_precision, weighted_recall,
    weighted_f1, auc, auc_folded`` (+ ``learning_time_s``).

    For every fraction and fold all algorithms are fitted, then one scan
    scores the pool with all of them and writes the narrow ``(name, label,
    prediction, score)`` rows. One grouped job over all written rows then gives
    every metric of every run, so the number of metric jobs depends neither on
    the algorithms nor on the fractions. The result (one row per algorithm and
    fraction) is small and bounded, so it is collected before the workspace is
    removed, the form of the original's result table. With ``parallelism > 1``
    independent fits are submitted from that many driver threads (timings then
    include the contention). With timing, each model also makes the full pass of
    its own that the original times.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "evaluate")
    try:
        # The caller's rows are evaluated once; every run reads the files.
        ws.write(df, "input")
        df = ws.read("input", df.schema)
        timings = []

        def parts(fraction, seed):
            flag = labeled_flag(id_col, fraction, seed)
            if test_fraction is None:
                return flag, df, df.where(~flag)
            held = ~flag & (unit_hash(id_col, seed + 7919) < F.lit(float(test_fraction)))
            return flag, df.where(~held), df.where(held)

        def fit(fraction, seed, est, name):
            flag, data, scored_rows = parts(fraction, seed)
            t0 = time.perf_counter()
            if isinstance(est, SemiSupervisedMarker):
                train = data.withColumn(label_col, F.when(flag, F.col(label_col)))
            else:
                train = data.where(flag)
            model = est.fit(train)
            if with_timing:
                model.transform(scored_rows).select("prediction").write.format("noop").mode("overwrite").save()
                timings.append((name, float(fraction), int(seed), time.perf_counter() - t0))
            return model, name

        def score(i, fraction, seed, models):
            rows = score_models(models, parts(fraction, seed)[2], label_col, positive)
            ws.write(rows.withColumn("label_fraction", F.lit(float(fraction))).withColumn("fold_seed", F.lit(int(seed))), f"runs/r={i}")

        folds = [(f, s) for f in fractions for s in fold_seeds]
        jobs = [(f, s, est, name) for f, s in folds for est, name in algorithms]
        fitted = run_parallel([lambda j=j: fit(*j) for j in jobs], parallelism)
        k = len(algorithms)
        run_parallel([lambda i=i, f=f: score(i, *f, fitted[i * k : (i + 1) * k]) for i, f in enumerate(folds)], parallelism)
        runs = ws.read("runs").drop("r")
        table = metrics_by(runs, ["name", "label_fraction", "fold_seed"], ws, positive)
        names = list(METRICS)
        if with_timing:
            times = spark.createDataFrame(timings, "name string, label_fraction double, fold_seed int, learning_time_s double")
            table = table.join(times, ["name", "label_fraction", "fold_seed"], "left")
            names.append("learning_time_s")
        table = table.groupBy("name", "label_fraction").agg(*[F.avg(m).alias(m) for m in names])
        rows = table.collect()
        schema = table.schema
    finally:
        ws.close()
    return spark.createDataFrame(rows, schema)


def roc_for(
    estimator: Estimator,
    df: DataFrame,
    fraction: float,
    seed: int,
    positive=1.0,
    id_col: str = "row_id",
    label_col: str = "label",
    path: str | None = None,
) -> DataFrame:
    """ROC curve of one classifier on one holdout (pool scored); written to
    ``path`` as well when given."""
    flag = labeled_flag(id_col, fraction, seed)
    train = df.withColumn(label_col, F.when(flag, F.col(label_col))) if isinstance(estimator, SemiSupervisedMarker) else df.where(flag)
    model = estimator.fit(train)
    pred = model.transform(df.where(~flag))
    s = pred.select(F.col(label_col).alias("label"), F.round(score_column(model, positive), 12).alias("score"))
    roc = roc_curve(s, "label", "score", positive)
    if path is not None:
        write_roc(roc, path)
    return roc
