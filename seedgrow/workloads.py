"""Catalogue of checkable workloads: one Spark callable per operator key.

Each callable takes ``(spark, sf_dir)``, reads the given tables and returns
a DataFrame whose columns match the DuckDB statement of the same key in
``seedgrow.oracle_catalog``. Doubles are rounded (6 places; scores 12) so
that summation order cannot change a hash.

Fixtures (all whole tables; labelled rows are chosen by the deterministic
hash split, never by an id pattern):

* loops: ``embeddings``, 10 % labelled (seed 42), Gaussian naive Bayes;
* duplicates: ``embeddings`` plus a second copy of about 20 % of its rows;
* metrics: ``documents`` joined to ``labels`` (target ``quality``);
* harness: binary form of ``embeddings`` (+1 for even class ids);
* text: lines built from ``part``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedgrow.functions.hashing import unit_hash
from seedgrow.functions.labels import index_of_label
from seedgrow.functions.vectors import as_array, max_probability, slice_vector, vector_size
from seedgrow.operators import dedup, indexing, metrics, pseudo, setops, splits
from seedgrow.plans import CoTraining, HardEM, SelfTraining
from seedgrow.plans.base import FEAT
from seedgrow.plans.cotraining import default_views
from seedgrow.plans.em import predict_with
from seedgrow.plans.evaluate import evaluate_all, roc_for, score_column
from seedgrow.plans.lineage import Workspace
from seedgrow.plans.supervised import Supervised
from seedgrow.sources import sinks, tables, text

# Fixed values of the fixtures (shared with the SQL oracle).
SEED = 42
FRACTION = 0.10
ST_THRESHOLD, ST_ITERS = 0.95, 3
EM_TOL, EM_ITERS = 1.0, 3
CT_THRESHOLD, CT_ITERS = 0.90, 3
CUSTOM_VIEW1 = [5, 0, 5, 63, 17, 42, 8, 30, 11, 11]
CUSTOM_VIEW2 = list(range(62, 20, -3))
SLICE_VIEW = [5, 0, 5]
DUP_SEED, DUP_FRACTION, DUP_ID_OFFSET = 7, 0.2, 1_000_000_000
METRIC_SEED, METRIC_FRACTION = 42, 0.34
HOLDOUT_FRACTION, HOLDOUT_SEEDS = 0.12, [42, 43, 44]
HARNESS_FRACTION, HARNESS_FOLDS = 0.12, [42, 43]
SWEEP_FRACTIONS = splits.sweep_fractions()
HARNESS_ST_ITERS = 3
HARNESS_EM_TOL, HARNESS_EM_ITERS = 3.0, 7
DOC_THRESHOLD, DOC_ITERS = 0.95, 3
SWAP_THRESHOLD, SWAP_ITERS = 0.95, 3

R6 = 6


def nb() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def rf(seed: int = 7) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=15, seed=seed)


# ------------------------------------------------------------------ fixtures

def class_labels(labeled: DataFrame) -> list[int]:
    """Class positions 0..k-1 of a learner fitted on the class indices in
    ``labeled``, read from the data."""
    top = labeled.agg(F.max("label").alias("m")).first()["m"]
    return list(range(int(top) + 1))


def loop_input(spark: SparkSession, sf: str) -> DataFrame:
    """``embeddings`` with labels hidden outside the 10 % seed."""
    return splits.semi_supervised_input(tables.embedding_samples(spark, sf), FRACTION, SEED)


def seed_and_pool(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = tables.embedding_samples(spark, sf)
    return splits.split_tables(s, FRACTION, SEED)


def seed_model(spark: SparkSession, sf: str, view=None):
    """Supervised Gaussian NB on the seed (optionally on a feature view)."""
    seed, _ = seed_and_pool(spark, sf)
    if view is not None:
        seed = seed.withColumn("view", slice_vector("features", view))
        return nb().setFeaturesCol("view").fit(seed)
    return nb().fit(seed)


def duplicated_pool(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(seed, pool) where the pool also holds a second copy (new id, label
    hidden) of about 20 % of all rows, chosen by hash."""
    s = tables.embedding_samples(spark, sf)
    seed, pool = splits.split_tables(s, FRACTION, SEED)
    copies = s.where(unit_hash("row_id", DUP_SEED) < F.lit(DUP_FRACTION)).select(
        (F.col("row_id") + F.lit(DUP_ID_OFFSET)).alias("row_id"), "features", "label"
    )
    return seed, pool.unionByName(copies)


def documents_indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    """``documents`` with ``label`` = frequency index of ``lang`` (over all
    documents, as the original tester indexes the full data)."""
    d = tables.document_samples(spark, sf)
    langs = indexing.frequency_labels(d, "label")
    return d.withColumn("label", index_of_label("label", langs)), langs


def quality_holdout(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = tables.quality_samples(spark, sf).where(F.col("label").isNotNull())
    return splits.split_tables(q, METRIC_FRACTION, METRIC_SEED)


def quality_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Pool of the quality holdout scored by NB fitted on its labelled part:
    ``label, prediction, score`` with score = P(quality = 1)."""
    train, test = quality_holdout(spark, sf)
    model = Supervised(nb()).fit(train)
    pred = model.transform(test)
    return pred.select("label", "prediction", F.round(score_column(model, 1.0), 12).alias("score"))


def _scored_rows(model, df: DataFrame) -> DataFrame:
    """``(row_id, prediction, confidence)`` of every row of ``df``."""
    p = model.transform(df)
    return p.select(
        "row_id",
        F.col("prediction").cast("double").alias("prediction"),
        F.round(max_probability("probability"), R6).alias("confidence"),
    )


# ------------------------------------------------------------------ sources

def q_labeled_text_parse(spark, sf):
    return _parsed(text.parse_labeled_lines(tables.part_lines(spark, sf), keep_line=True))


def _parsed(lines: DataFrame) -> DataFrame:
    parsed = text.good_lines(lines)
    arr = as_array("features")
    return parsed.select(
        "line",
        "label",
        F.size(arr).alias("n_features"),
        F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("f_sum"),
        F.element_at(arr, 1).alias("f_first"),
        F.element_at(arr, -1).alias("f_last"),
    )


def q_labeled_text_rejects(spark, sf):
    parsed = text.rejected_lines(text.parse_labeled_lines(tables.part_lines(spark, sf)))
    return parsed.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n_lines"))


# ------------------------------------------------------------------ projections

def q_hide_labels(spark, sf):
    _, pool = seed_and_pool(spark, sf)
    h = pseudo.hide_labels(pool)
    return h.select("row_id", "label", vector_size("features").alias("dims"))


def q_mark_unlabeled(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    return pseudo.mark_unlabeled(seed, pool).select("row_id", "label")


def q_mixed_features(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    m = pseudo.mixed_features(seed, pool)
    arr = as_array("features")
    return m.select(
        "row_id", F.size(arr).cast("long").alias("dims"), F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), R6).alias("f_sum")
    )


def q_feature_count(spark, sf):
    return pseudo.feature_dims(tables.embedding_samples(spark, sf))


def q_class_partition(spark, sf):
    b = tables.binary_embedding_samples(spark, sf)
    pos = b.where(F.col("label") == F.lit(1.0)).select("row_id", "label")
    neg = b.where(F.col("label") == F.lit(-1.0)).select("row_id", "label")
    return pos.withColumn("part", F.lit("positive")).unionByName(neg.withColumn("part", F.lit("negative")))


def q_label_index(spark, sf):
    return indexing.label_index_table(tables.document_samples(spark, sf), "label")


def q_label_roundtrip(spark, sf):
    """Labels to indices and back, through the dictionary table."""
    d = tables.document_samples(spark, sf).select("row_id", "label")
    dictionary = indexing.label_index_table(d, "label")
    there = indexing.with_label_index(d, dictionary, "label")
    return indexing.with_label(there, dictionary, "label_index", "label_back")


# ------------------------------------------------------------------ splits

def q_stratified_split(spark, sf):
    b = splits.stratified_split(tables.binary_embedding_samples(spark, sf), HOLDOUT_FRACTION, SEED)
    return b.groupBy("label", "is_labeled").agg(F.count(F.lit(1)).alias("n"))


def q_repeated_holdout(spark, sf):
    return splits.holdout_counts(tables.binary_embedding_samples(spark, sf), HOLDOUT_FRACTION, HOLDOUT_SEEDS)


# ------------------------------------------------------------------ views

def q_feature_view_slice(spark, sf):
    e = tables.embedding_samples(spark, sf)
    arr = as_array(slice_vector("features", SLICE_VIEW))
    return e.select("row_id", *[F.round(arr[i], R6).alias(f"x{i}") for i in range(len(SLICE_VIEW))])


def q_feature_view_default(spark, sf):
    e = tables.embedding_samples(spark, sf)
    dim = pseudo.feature_count(e)
    v1, v2 = default_views(dim)
    a1, a2 = as_array(slice_vector("features", v1)), as_array(slice_vector("features", v2))
    add = lambda a, x: a + x
    return e.select(
        "row_id",
        F.size(a1).alias("dim1"),
        F.size(a2).alias("dim2"),
        F.round(F.aggregate(a1, F.lit(0.0), add), R6).alias("sum1"),
        F.round(F.aggregate(a2, F.lit(0.0), add), R6).alias("sum2"),
    )


def q_view_scoring(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    v1, _ = default_views(pseudo.feature_count(seed))
    model = seed_model(spark, sf, v1)
    pool = pool.withColumn("view", slice_vector("features", v1))
    r = pseudo.reliable_pseudo_labels(model, pool, CT_THRESHOLD, class_labels(seed), scoring_features_col="view")
    return r.select("row_id", "label", vector_size("features").alias("dims"))


# ------------------------------------------------------------------ base learner and pseudo-labels

def q_base_learner_fit(spark, sf):
    """Fitted NB parameters as a table (size: classes x features)."""
    seed, _ = seed_and_pool(spark, sf)
    model = Supervised(nb()).fit(seed)
    m = model.baseModel
    theta, sigma, pi = m.theta.toArray(), m.sigma.toArray(), m.pi.toArray()
    rows = [
        (float(model.labels[c]), j, float(theta[c, j]), float(sigma[c, j]), float(pi[c]))
        for c in range(theta.shape[0])
        for j in range(theta.shape[1])
    ]
    df = spark.createDataFrame(rows, "label double, j int, mu double, var double, log_prior double")
    return df.select("label", "j", *[F.round(c, R6).alias(c) for c in ("mu", "var", "log_prior")])


def q_base_learner_predict(spark, sf):
    model = Supervised(nb()).fit(seed_and_pool(spark, sf)[0])
    return _scored_rows(model, seed_and_pool(spark, sf)[1])


def q_supervised_nb(spark, sf):
    docs, _ = documents_indexed(spark, sf)
    train = splits.semi_supervised_input(docs, FRACTION, SEED)
    model = Supervised(nb()).fit(train)
    return _scored_rows(model, docs)


def q_confidence_filter(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    model = Supervised(nb()).fit(seed)
    kept = pseudo.confidence_filter(model.transform(pool), ST_THRESHOLD)
    return kept.select(
        "row_id", F.col("prediction").alias("prediction"), F.round(max_probability("probability"), R6).alias("confidence")
    )


def q_reliable_pseudo_labels(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    model = nb().fit(seed)
    return pseudo.reliable_pseudo_labels(model, pool, ST_THRESHOLD, class_labels(seed)).select("row_id", "label")


def q_pseudo_label_all(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    model = nb().fit(seed)
    return pseudo.pseudo_label_all(model, pool, class_labels(seed)).select("row_id", "label")


# ------------------------------------------------------------------ set operations

def _written_once(df: DataFrame) -> DataFrame:
    """``df`` written under the checkpoint folder and read back: accepted rows
    that several branches use are scored once."""
    ws = Workspace(df.sparkSession, "accepted", keep=True)
    ws.write(df, "rows")
    return ws.read("rows", df.schema)


def _one_round(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    model = nb().fit(seed)
    acc = pseudo.reliable_pseudo_labels(model, pool, ST_THRESHOLD, class_labels(seed))
    return seed, pool, model, acc


def q_grow_labeled(spark, sf):
    seed, _, _, acc = _one_round(spark, sf)
    return setops.grow_labeled(seed.select("row_id", "label", "features"), acc).select("row_id", "label")


def q_mix_labeled_predicted(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    model = nb().fit(seed)
    allp = pseudo.pseudo_label_all(model, pool, class_labels(seed))
    return setops.mix_labeled_predicted(seed.select("row_id", "label", "features"), allp).select("row_id", "label")


def q_pool_except(spark, sf):
    seed, pool = duplicated_pool(spark, sf)
    model = nb().fit(seed)
    acc = _written_once(pseudo.reliable_pseudo_labels(model, pool, ST_THRESHOLD, class_labels(seed)))
    return setops.pool_except(pool, acc).select("row_id")


def q_pool_anti_by_id(spark, sf):
    seed, pool = duplicated_pool(spark, sf)
    model = nb().fit(seed)
    acc = pseudo.reliable_pseudo_labels(model, pool, ST_THRESHOLD, class_labels(seed))
    return setops.pool_anti_by_id(pool, acc).select("row_id")


def _exchange(spark, sf):
    seed, pool = seed_and_pool(spark, sf)
    v1, v2 = default_views(pseudo.feature_count(seed))
    out = []
    for v in (v1, v2):
        m = nb().setFeaturesCol("view").fit(seed.withColumn("view", slice_vector("features", v)))
        acc = pseudo.reliable_pseudo_labels(
            m, pool.withColumn("view", slice_vector("features", v)), CT_THRESHOLD, class_labels(seed),
            scoring_features_col="view",
        )
        out.append(_written_once(acc))
    s = seed.select("row_id", "label", "features")
    return setops.cross_teach(s, s, pool, pool, out[0], out[1])


def q_cross_teach(spark, sf):
    l1, l2, u1, u2 = _exchange(spark, sf)
    parts = [
        l1.select(F.lit("labeled1").alias("table_name"), "row_id", "label"),
        l2.select(F.lit("labeled2").alias("table_name"), "row_id", "label"),
        u1.select(F.lit("unlabeled1").alias("table_name"), "row_id", F.lit(None).cast("double").alias("label")),
        u2.select(F.lit("unlabeled2").alias("table_name"), "row_id", F.lit(None).cast("double").alias("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_agreement_intersect(spark, sf):
    l1, l2, _, _ = _exchange(spark, sf)
    a = setops.agreement(l1, l2)
    arr = as_array("features")
    return a.select("label", F.round(F.aggregate(arr, F.lit(0.0), lambda x, y: x + y), R6).alias("f_sum"))


# ------------------------------------------------------------------ loops

def _history(model, cols):
    return model.history.select(*cols)


ST_COLS = ["iteration", "n_labeled", "n_unlabeled", "n_new"]
def em_cols():
    return ["iteration", F.round("residual_pct", R6).alias("residual_pct"), "n_changed", "n_labeled", "n_unlabeled"]
CT_COLS = ["iteration", "n_new1", "n_new2", "n_labeled1", "n_labeled2", "n_unlabeled1", "n_unlabeled2", "n_agreement"]


def fit_selftraining(spark, sf):
    return SelfTraining(nb(), threshold=ST_THRESHOLD, maxIter=ST_ITERS).fit(loop_input(spark, sf))


def fit_em(spark, sf):
    return HardEM(nb(), tolPercent=EM_TOL, maxIter=EM_ITERS).fit(loop_input(spark, sf))


def fit_cotraining(spark, sf, v1=None, v2=None):
    return CoTraining(nb(), threshold=CT_THRESHOLD, maxIter=CT_ITERS, view1Indices=v1, view2Indices=v2,
                      trackAgreement=True).fit(loop_input(spark, sf))


def q_selftraining_history(spark, sf):
    return _history(fit_selftraining(spark, sf), ST_COLS)


def q_selftraining_predict(spark, sf):
    return _scored_rows(fit_selftraining(spark, sf), tables.embedding_samples(spark, sf))


def q_em_history(spark, sf):
    return _history(fit_em(spark, sf), em_cols())


def q_em_predict(spark, sf):
    return _scored_rows(fit_em(spark, sf), tables.embedding_samples(spark, sf))


def q_em_final_training_set(spark, sf):
    m = fit_em(spark, sf)
    seed, pool = seed_and_pool(spark, sf)
    p = pseudo.pseudo_label_all(m.loopModel, pool, m.labels)
    return setops.mix_labeled_predicted(seed.select("row_id", "label", "features"), p).select("row_id", "label")


def q_label_residual(spark, sf):
    """Changed-label percent between the seed model and the model refitted
    on seed + all its pseudo-labels (EM's second residual)."""
    seed, pool = seed_and_pool(spark, sf)
    m0 = nb().fit(seed)
    p0 = pseudo.pseudo_label_all(m0, pool, class_labels(seed))
    m1 = nb().fit(setops.mix_labeled_predicted(seed.select("row_id", "label", "features"), p0))
    rows = pool.select(F.col("features").alias(FEAT))
    j = predict_with(m1, predict_with(m0, rows, "prev"), "cur")  # both models on the same row
    changed = (F.col("prev") != F.col("cur")).cast("long")
    return j.agg(
        F.round(metrics.label_residual("prev", "cur"), R6).alias("residual_pct"),
        F.sum(changed).alias("n_changed"),
        F.count(F.lit(1)).alias("n"),
    )


def q_cotraining_history(spark, sf):
    return _history(fit_cotraining(spark, sf), CT_COLS)


def q_cotraining_predict(spark, sf):
    return _scored_rows(fit_cotraining(spark, sf), tables.embedding_samples(spark, sf))


def q_cotraining_custom_views(spark, sf):
    return _history(fit_cotraining(spark, sf, CUSTOM_VIEW1, CUSTOM_VIEW2), CT_COLS)


# ------------------------------------------------------------------ metrics

def q_confusion_matrix(spark, sf):
    return metrics.confusion_counts(quality_scored(spark, sf))


def q_weighted_metrics(spark, sf):
    w = metrics.weighted_metrics(quality_scored(spark, sf))
    return w.select(*[F.round(c, R6).alias(c) for c in ("weighted_precision", "weighted_recall", "weighted_f1", "accuracy")], "n")


def q_auc_roc(spark, sf):
    a = metrics.auc(quality_scored(spark, sf), "label", "score", 1.0)
    return a.select(F.round("auc", R6).alias("auc"), F.round("auc_folded", R6).alias("auc_folded"), "n_pos", "n_neg")


def q_roc_curve(spark, sf):
    r = metrics.roc_curve(quality_scored(spark, sf), "label", "score", 1.0)
    return r.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


# ------------------------------------------------------------------ harness

def q_pipeline_compose(spark, sf):
    """Self-Training inside a ``Pipeline`` followed by ``IndexToString``."""
    docs, langs = documents_indexed(spark, sf)
    train = splits.semi_supervised_input(docs, FRACTION, SEED)
    st = SelfTraining(nb(), threshold=DOC_THRESHOLD, maxIter=DOC_ITERS)
    pipe = Pipeline(stages=[st, IndexToString(inputCol="prediction", outputCol="predicted_lang", labels=langs)])
    model = pipe.fit(train)
    return model.transform(docs).select("row_id", "predicted_lang")


def _every_algorithm():
    return [
        (Supervised(nb()), "NaiveBayes"),
        (SelfTraining(nb(), threshold=ST_THRESHOLD, maxIter=HARNESS_ST_ITERS), "SelfTraining"),
        (HardEM(nb(), tolPercent=HARNESS_EM_TOL, maxIter=HARNESS_EM_ITERS), "EM"),
        (CoTraining(nb(), nb(), nb(), threshold=CT_THRESHOLD, maxIter=CT_ITERS), "CoTraining"),
    ]


def _round_results(df: DataFrame) -> DataFrame:
    return df.select(
        "name", "label_fraction", *[F.round(c, R6).alias(c) for c in ("weighted_precision", "weighted_recall", "weighted_f1", "auc", "auc_folded")]
    )


def q_evaluate_all_metrics(spark, sf):
    b = tables.binary_embedding_samples(spark, sf)
    return _round_results(evaluate_all(_every_algorithm(), b, [HARNESS_FRACTION], HARNESS_FOLDS, 1.0, parallelism=4))


def q_fraction_sweep(spark, sf):
    b = tables.binary_embedding_samples(spark, sf)
    return _round_results(evaluate_all(_every_algorithm(), b, SWEEP_FRACTIONS, [SEED], 1.0, parallelism=4))


def q_roc_evaluation(spark, sf):
    """ROC of Self-Training on one holdout of the binary fixture."""
    b = tables.binary_embedding_samples(spark, sf)
    st = SelfTraining(nb(), threshold=ST_THRESHOLD, maxIter=HARNESS_ST_ITERS)
    r = roc_for(st, b, HARNESS_FRACTION, SEED, 1.0)
    return r.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def _written(spark, kind: str) -> str:
    """A new folder under the checkpoint folder for a query that writes."""
    return Workspace(spark, kind, keep=True).path("out")


def q_text_file_round_trip(spark, sf):
    """The text source on files: lines written as text, read by
    ``spark.read.text``, parsed."""
    path = _written(spark, "text")
    tables.part_lines(spark, sf).write.text(path)
    return _parsed(text.read_labeled_text(spark, path, keep_line=True))


def q_results_read_back(spark, sf):
    """The per-algorithm result sink, read back."""
    b = tables.binary_embedding_samples(spark, sf)
    path = _written(spark, "results")
    sinks.write_results(evaluate_all(_every_algorithm(), b, [HARNESS_FRACTION], [SEED], 1.0, parallelism=4), path)
    return _round_results(spark.read.parquet(path))


def q_overwrite_read_back(spark, sf):
    """The result sink writes two tables to one place; the second is read."""
    path = _written(spark, "overwrite")
    counts = tables.document_samples(spark, sf).groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_results(counts, path)
    before = spark.read.parquet(path)
    # The second write reads the table that it replaces.
    sinks.write_results(before.where(F.col("name") != "en").withColumn("n", F.col("n") * 10), path)
    return spark.read.parquet(path).select("name", "n")


def q_roc_read_back(spark, sf):
    """The ROC sink, read back."""
    path = _written(spark, "roc")
    sinks.write_roc(metrics.roc_curve(quality_scored(spark, sf), "label", "score", 1.0), path)
    r = spark.read.parquet(path)
    return r.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def q_roc_one_class(spark, sf):
    """ROC of input that holds positives only: rates over the absent class
    are null."""
    s = tables.read_table(spark, sf, "labels").where(F.col("quality").isNotNull())
    s = s.select(F.lit(1.0).alias("label"), (F.col("quality").cast("double") / 2).alias("score"))
    r = metrics.roc_curve(s, "label", "score", 1.0)
    return r.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def q_em_tolerance_history(spark, sf):
    """EM with the original's settings: it may stop on the residual."""
    m = HardEM(nb(), tolPercent=HARNESS_EM_TOL, maxIter=HARNESS_EM_ITERS).fit(loop_input(spark, sf))
    return _history(m, em_cols())


def q_custom_columns(spark, sf):
    """Self-Training on renamed columns."""
    rename = {"row_id": "key", "features": "x", "label": "y"}
    est = SelfTraining(nb(), threshold=ST_THRESHOLD, maxIter=ST_ITERS, featuresCol="x", labelCol="y", idCol="key")
    m = est.fit(loop_input(spark, sf).withColumnsRenamed(rename))
    m.setPredictionCol("guess").setProbabilityCol("p").setRawPredictionCol("raw")
    out = m.transform(tables.embedding_samples(spark, sf).withColumnsRenamed(rename))
    return out.select(
        F.col("key").alias("row_id"), F.col("guess").alias("prediction"),
        F.round(max_probability("p"), R6).alias("confidence"),
    )


def q_duplicate_summary(spark, sf):
    """Rows and distinct vectors of the duplicated pool (the ``features``
    match mode's first-copy flag)."""
    _, pool = duplicated_pool(spark, sf)
    return dedup.duplicate_summary(pool)


def q_selftraining_dedup_history(spark, sf):
    """Self-Training in ``features`` mode on the duplicated pool."""
    seed, pool = duplicated_pool(spark, sf)
    data = seed.unionByName(pool.withColumn("label", F.lit(None).cast("double")))
    m = SelfTraining(nb(), threshold=ST_THRESHOLD, maxIter=ST_ITERS, matchMode="features").fit(data)
    return _history(m, ST_COLS)


def q_selftraining_id_history(spark, sf):
    """Self-Training in ``id`` mode on the duplicated pool."""
    seed, pool = duplicated_pool(spark, sf)
    data = seed.unionByName(pool.withColumn("label", F.lit(None).cast("double")))
    m = SelfTraining(nb(), threshold=ST_THRESHOLD, maxIter=ST_ITERS, matchMode="id").fit(data)
    return _history(m, ST_COLS)


# ------------------------------------------------------------------ random forest (rows-only) and another learner

def _doc_predictions(spark, sf, est):
    docs, _ = documents_indexed(spark, sf)
    train = splits.semi_supervised_input(docs, FRACTION, SEED)
    model = est.fit(train)
    return model.transform(docs).select("row_id", F.col("prediction").cast("double").alias("prediction"))


def q_supervised_rf(spark, sf):
    return _doc_predictions(spark, sf, Supervised(rf()))


def q_selftraining_rf(spark, sf):
    return _doc_predictions(spark, sf, SelfTraining(rf(), threshold=0.95, maxIter=3))


def q_em_rf(spark, sf):
    return _doc_predictions(spark, sf, HardEM(rf(), tolPercent=3.0, maxIter=7))


def q_cotraining_rf(spark, sf):
    return _doc_predictions(spark, sf, CoTraining(rf(1), rf(2), rf(3), threshold=0.90, maxIter=3))


def q_base_learner_swap(spark, sf):
    """Self-Training around another learner: multinomial naive Bayes on
    letters per hundred characters."""
    docs, _ = documents_indexed(spark, sf)
    per_hundred = F.transform(as_array("features"), lambda x: x * 100)
    docs = docs.withColumn("features", array_to_vector(per_hundred))
    est = SelfTraining(NaiveBayes(modelType="multinomial"), threshold=SWAP_THRESHOLD, maxIter=SWAP_ITERS, matchMode="id")
    model = est.fit(splits.semi_supervised_input(docs, FRACTION, SEED))
    return _scored_rows(model, docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "labeled_text_parse": q_labeled_text_parse,
    "labeled_text_rejects": q_labeled_text_rejects,
    "hide_labels": q_hide_labels,
    "mark_unlabeled": q_mark_unlabeled,
    "mixed_features": q_mixed_features,
    "feature_count": q_feature_count,
    "class_partition": q_class_partition,
    "label_index": q_label_index,
    "label_roundtrip": q_label_roundtrip,
    "stratified_split": q_stratified_split,
    "repeated_holdout": q_repeated_holdout,
    "feature_view_slice": q_feature_view_slice,
    "feature_view_default": q_feature_view_default,
    "view_scoring": q_view_scoring,
    "base_learner_fit": q_base_learner_fit,
    "base_learner_predict": q_base_learner_predict,
    "supervised_nb": q_supervised_nb,
    "confidence_filter": q_confidence_filter,
    "reliable_pseudo_labels": q_reliable_pseudo_labels,
    "pseudo_label_all": q_pseudo_label_all,
    "grow_labeled": q_grow_labeled,
    "mix_labeled_predicted": q_mix_labeled_predicted,
    "pool_except": q_pool_except,
    "pool_anti_by_id": q_pool_anti_by_id,
    "cross_teach": q_cross_teach,
    "agreement_intersect": q_agreement_intersect,
    "duplicate_summary": q_duplicate_summary,
    "text_file_round_trip": q_text_file_round_trip,
    "results_read_back": q_results_read_back,
    "overwrite_read_back": q_overwrite_read_back,
    "roc_read_back": q_roc_read_back,
    "roc_one_class": q_roc_one_class,
    "em_tolerance_history": q_em_tolerance_history,
    "custom_columns": q_custom_columns,
    "selftraining_history": q_selftraining_history,
    "selftraining_predict": q_selftraining_predict,
    "selftraining_dedup_history": q_selftraining_dedup_history,
    "selftraining_id_history": q_selftraining_id_history,
    "em_history": q_em_history,
    "em_predict": q_em_predict,
    "em_final_training_set": q_em_final_training_set,
    "label_residual": q_label_residual,
    "cotraining_history": q_cotraining_history,
    "cotraining_predict": q_cotraining_predict,
    "cotraining_custom_views": q_cotraining_custom_views,
    "confusion_matrix": q_confusion_matrix,
    "weighted_metrics": q_weighted_metrics,
    "auc_roc": q_auc_roc,
    "roc_curve": q_roc_curve,
    "roc_evaluation": q_roc_evaluation,
    "pipeline_compose": q_pipeline_compose,
    "evaluate_all_metrics": q_evaluate_all_metrics,
    "fraction_sweep": q_fraction_sweep,
    "supervised_rf": q_supervised_rf,
    "selftraining_rf": q_selftraining_rf,
    "em_rf": q_em_rf,
    "cotraining_rf": q_cotraining_rf,
    "base_learner_swap": q_base_learner_swap,
}
