"""Loop semantics: independent expected values and invariants."""

import glob
import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import vec_df, SF_MID, SF_SMALL
from seedgrow import CoTraining, HardEM, SelfTraining
from seedgrow.plans.base import SemiSupervisedMarker
from seedgrow.plans.lineage import checkpoint_root
from seedgrow.plans.supervised import Supervised
from seedgrow.sources import embedding_samples


def nb():
    return NaiveBayes(modelType="gaussian")


def every_tenth(spark, sf):
    """Seed = ids divisible by 10: the layout whose loop values were derived
    independently (unrolled SQL) before any engine code existed."""
    df = embedding_samples(spark, sf)
    return df.withColumn("label", F.when(F.col("row_id") % 10 == 0, F.col("label")))


def test_selftraining_known_values(spark):
    m = SelfTraining(nb(), threshold=0.95, maxIter=3).fit(every_tenth(spark, SF_MID))
    assert [r["n_new"] for r in m.history_rows] == [363, 19, 6]


def test_em_known_residuals(spark):
    m = HardEM(nb(), tolPercent=0.0, maxIter=5).fit(every_tenth(spark, SF_MID))
    assert [round(r["residual_pct"], 3) for r in m.history_rows] == [100.0, 4.222, 2.0, 2.0, 1.111]


def test_cotraining_known_values(spark):
    m = CoTraining(nb(), threshold=0.90, maxIter=3, trackAgreement=True).fit(every_tenth(spark, SF_MID))
    got = [(r["n_new1"], r["n_new2"], r["n_agreement"]) for r in m.history_rows]
    assert got == [(287, 263, 106), (3, 22, 121), (0, 0, 121)]


def test_id_mode_conserves_rows(spark):
    df = every_tenth(spark, SF_SMALL)
    n = df.count()
    m = SelfTraining(nb(), threshold=0.95, maxIter=3, matchMode="id").fit(df)
    for r in m.history_rows:
        assert r["n_labeled"] + r["n_unlabeled"] == n


def test_threshold_one_accepts_nothing_and_stops(spark):
    m = SelfTraining(nb(), threshold=1.0, maxIter=5).fit(every_tenth(spark, SF_SMALL))
    assert len(m.history_rows) == 1 and m.history_rows[0]["n_new"] == 0


def test_empty_pool_is_supervised(spark):
    df = embedding_samples(spark, SF_SMALL)
    for est in (SelfTraining(nb()), HardEM(nb()), CoTraining(nb())):
        m = est.fit(df)
        assert m.history_rows == []
        assert m.transform(df).where("prediction IS NULL").count() == 0


def test_one_class_seed_is_rejected(spark):
    df = embedding_samples(spark, SF_SMALL).withColumn(
        "label", F.when(F.col("label") == 3, F.col("label"))
    )
    with pytest.raises(ValueError, match="two classes"):
        SelfTraining(nb()).fit(df)


def test_base_learner_must_be_probabilistic():
    with pytest.raises(TypeError):
        SelfTraining(LinearSVC())


def test_agreement_contains_all_originals(spark):
    df = every_tenth(spark, SF_SMALL)
    n_seed = df.where("label IS NOT NULL").count()
    m = CoTraining(nb(), threshold=0.9, maxIter=3, trackAgreement=True).fit(df)
    assert all(r["n_agreement"] >= n_seed for r in m.history_rows)


def test_em_first_residual_is_100(spark):
    m = HardEM(nb(), tolPercent=0.0, maxIter=2).fit(every_tenth(spark, SF_SMALL))
    assert m.history_rows[0]["residual_pct"] == 100.0


def test_views_permuted_or_repeated(spark):
    df = every_tenth(spark, SF_SMALL)
    m = CoTraining(nb(), threshold=0.9, maxIter=1, view1Indices=[5, 0, 5], view2Indices=[63, 1]).fit(df)
    assert m.views == ([5, 0, 5], [63, 1])
    with pytest.raises(ValueError, match="outside"):
        CoTraining(nb(), view1Indices=[64], view2Indices=[0]).fit(df)


def test_one_feature_needs_explicit_views(spark):
    rows = [(i, Vectors.dense([float(i % 7)]), float(i % 2) if i < 10 else None) for i in range(40)]
    df = vec_df(spark, rows, "row_id long, features vector, label double")
    with pytest.raises(ValueError, match="two features"):
        CoTraining(nb()).fit(df)


def test_plus_minus_one_labels_round_trip(spark):
    df = embedding_samples(spark, SF_SMALL).withColumn(
        "label", F.when(F.col("row_id") % 10 == 0, F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0))
    )
    m = SelfTraining(nb(), threshold=0.9, maxIter=2).fit(df)
    assert sorted(m.labels) == [-1.0, 1.0]
    preds = {r[0] for r in m.transform(df).select("prediction").distinct().collect()}
    assert preds <= {-1.0, 1.0}


def test_duplicated_vectors_features_mode(spark):
    """A vector repeated in the pool leaves the pool as one copy after the
    first shrink; in id mode every copy stays until accepted."""
    base = [(i, Vectors.dense([float(i % 5), float(i % 3)]), float(i % 2) if i < 20 else None) for i in range(60)]
    dups = [(1000 + i, Vectors.sparse(2, {0: float(i % 5), 1: float(i % 3)} if i % 15 else {}), None) for i in range(20, 60)]
    df = vec_df(spark, base + dups, "row_id long, features vector, label double")
    mf = SelfTraining(nb(), threshold=0.999999, maxIter=2, matchMode="features").fit(df)
    mi = SelfTraining(nb(), threshold=0.999999, maxIter=2, matchMode="id").fit(df)
    distinct_pool = df.where("label IS NULL").select(F.col("features").cast("string")).count()
    assert mf.history_rows[0]["n_unlabeled"] <= mi.history_rows[0]["n_unlabeled"]
    assert mi.history_rows[0]["n_unlabeled"] + mi.history_rows[0]["n_new"] == 80
    assert distinct_pool == 80


def test_pipeline_and_copy(spark):
    df = every_tenth(spark, SF_SMALL)
    st = SelfTraining(nb(), threshold=0.95, maxIter=1)
    other = st.copy({st.threshold: 0.5})
    assert st.getThreshold() == 0.95 and other.getThreshold() == 0.5
    assert other.base is not st.base
    model = Pipeline(stages=[st]).fit(df)
    assert model.transform(df).count() == df.count()
    assert isinstance(st, SemiSupervisedMarker) and not isinstance(Supervised(nb()), SemiSupervisedMarker)


def test_other_base_learners(spark):
    df = every_tenth(spark, SF_SMALL)
    m = SelfTraining(LogisticRegression(maxIter=20), threshold=0.8, maxIter=2).fit(df)
    assert m.transform(df).where("prediction IS NULL").count() == 0


def test_no_state_left_after_fit(spark):
    root = checkpoint_root(spark).replace("file:", "")
    before = set(glob.glob(os.path.join(root, "seedgrow-*")))
    SelfTraining(nb(), maxIter=2).fit(every_tenth(spark, SF_SMALL))
    HardEM(nb(), maxIter=2).fit(every_tenth(spark, SF_SMALL))
    CoTraining(nb(), maxIter=2).fit(every_tenth(spark, SF_SMALL))
    after = set(glob.glob(os.path.join(root, "seedgrow-*")))
    assert after == before


def test_history_is_a_dataframe(spark):
    m = SelfTraining(nb(), maxIter=2).fit(every_tenth(spark, SF_SMALL))
    h = m.history
    assert h.columns[:4] == ["iteration", "n_labeled", "n_unlabeled", "n_new"]
    assert h.count() == len(m.history_rows)


def test_model_save_load(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from seedgrow import SemiSupervisedModel

    df = embedding_samples(spark, SF_SMALL).withColumn(
        "label", F.when(F.col("row_id") % 10 == 0, F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0))
    )
    m = SelfTraining(nb(), threshold=0.9, maxIter=2).fit(df)
    m.write().overwrite().save(str(tmp_path / "m"))
    back = SemiSupervisedModel.load(str(tmp_path / "m"))
    assert back.labels == m.labels and back.history_rows == m.history_rows and back.identity == m.identity
    a = m.transform(df).select("row_id", "prediction").orderBy("row_id").collect()
    b = back.transform(df).select("row_id", "prediction").orderBy("row_id").collect()
    assert a == b
    pm = Pipeline(stages=[SelfTraining(nb(), threshold=0.9, maxIter=1)]).fit(df)
    pm.write().overwrite().save(str(tmp_path / "p"))
    pb = PipelineModel.load(str(tmp_path / "p"))
    assert pb.transform(df).count() == df.count()


def test_order_and_partitioning_do_not_matter(spark):
    df = every_tenth(spark, SF_SMALL)
    a = SelfTraining(nb(), threshold=0.95, maxIter=3).fit(df)
    b = SelfTraining(nb(), threshold=0.95, maxIter=3).fit(df.orderBy(F.col("row_id").desc()).repartition(5))
    assert a.history_rows and [r["n_new"] for r in a.history_rows] == [r["n_new"] for r in b.history_rows]
    pa = a.transform(df).select("row_id", "prediction").orderBy("row_id").collect()
    pb = b.transform(df).select("row_id", "prediction").orderBy("row_id").collect()
    assert pa == pb


def test_hot_vector_holding_a_third_of_the_pool(spark):
    """One vector repeated across a third of the pool: the first-copy flag
    keeps exactly one copy, and features mode removes the rest of the copies
    after the first shrink."""
    from seedgrow.operators.dedup import duplicate_summary

    n = 300
    rows = []
    for i in range(n):
        vec = Vectors.dense([1.0, 2.0]) if i % 3 == 0 else Vectors.dense([float(i), float(i % 7)])
        lab = float(i % 2) if i % 10 in (1, 2) else None
        rows.append((i, vec, lab))
    df = vec_df(spark, rows, "row_id long, features vector, label double")
    pool = df.where("label IS NULL")
    s = duplicate_summary(pool).first()
    n_hot = pool.where(F.col("row_id") % 3 == 0).count()
    assert s["n_rows"] - s["n_distinct"] == n_hot - 1
    m = SelfTraining(nb(), threshold=1.0, maxIter=1, matchMode="features").fit(df)
    assert m.history_rows[0]["n_unlabeled"] == s["n_distinct"]


def test_reliable_with_transform(spark):
    from seedgrow.functions import slice_vector
    from seedgrow.operators.pseudo import reliable_pseudo_labels
    from seedgrow import workloads as W

    seed, pool = W.seed_and_pool(spark, SF_SMALL)
    view = list(range(32))
    m = nb().setFeaturesCol("v").fit(seed.withColumn("v", slice_vector("features", view)))
    a = reliable_pseudo_labels(m, pool.withColumn("v", slice_vector("features", view)), 0.9, list(range(10)),
                               scoring_features_col="v").select("row_id", "label")
    b = reliable_pseudo_labels(m, pool, 0.9, list(range(10)), transform=lambda c: slice_vector(c, view)).select("row_id", "label")
    assert sorted(a.collect()) == sorted(b.collect())


def test_cross_validator_mechanics(spark):
    """Param maps and copies work under CrossValidator (fully labelled data:
    MLlib evaluators cannot score null labels)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    df = embedding_samples(spark, SF_SMALL)
    st = SelfTraining(nb(), maxIter=1)
    grid = ParamGridBuilder().addGrid(st.threshold, [0.9, 0.99]).build()
    cv = CrossValidator(estimator=st, estimatorParamMaps=grid, numFolds=2, seed=1,
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"))
    m = cv.fit(df)
    assert len(m.avgMetrics) == 2


def test_duplicate_ids_are_rejected(spark):
    df = every_tenth(spark, SF_SMALL)
    dup = df.unionByName(df.where("label IS NULL"))
    with pytest.raises(ValueError, match="not a unique row id"):
        SelfTraining(nb(), maxIter=1).fit(dup)


def test_setters_chain_like_spark(spark):
    st = SelfTraining(nb()).setThreshold(0.9).setMaxIter(2).setFeaturesCol("features").setLabelCol("label")
    assert (st.getThreshold(), st.getMaxIter()) == (0.9, 2)
    em = HardEM(nb()).setTolPercent(3.0).setMaxIter(7).setVerbose(True)
    assert (em.getTolPercent(), em.getMaxIter()) == (3.0, 7)
    ct = CoTraining(nb()).setThreshold(0.8).setViews([0, 1], [2, 3]).setParallelism(1)
    assert ct.getThreshold() == 0.8 and ct.getOrDefault(ct.view2Indices) == [2, 3]
    m = em.fit(every_tenth(spark, SF_SMALL))
    assert m.history_rows


@pytest.mark.parametrize("mode", ["features", "id"])
def test_compaction_does_not_change_results(spark, mode):
    """Replaying every model over the original pool and rewriting the pool
    every iteration give the same loop."""
    from seedgrow import workloads as W

    seed, pool = W.duplicated_pool(spark, SF_SMALL)
    df = seed.unionByName(pool.withColumn("label", F.lit(None).cast("double")))
    never = SelfTraining(nb(), threshold=0.95, maxIter=3, matchMode=mode).setCompactRatio(0.0).setMaxChain(100).fit(df)
    always = SelfTraining(nb(), threshold=0.95, maxIter=3, matchMode=mode).setCompactRatio(1.01).setMaxChain(1).fit(df)
    keys = ("iteration", "n_labeled", "n_unlabeled", "n_new")
    assert [tuple(r[k] for k in keys) for r in never.history_rows] == [tuple(r[k] for k in keys) for r in always.history_rows]
    pa = never.transform(df).select("row_id", "prediction").orderBy("row_id").collect()
    pb = always.transform(df).select("row_id", "prediction").orderBy("row_id").collect()
    assert pa == pb
    ct_never = CoTraining(nb(), threshold=0.9, maxIter=3, matchMode=mode).setCompactRatio(0.0).setMaxChain(100).fit(df)
    ct_always = CoTraining(nb(), threshold=0.9, maxIter=3, matchMode=mode).setCompactRatio(1.01).setMaxChain(1).fit(df)
    ck = ("n_new1", "n_new2", "n_unlabeled1", "n_unlabeled2")
    assert [tuple(r[k] for k in ck) for r in ct_never.history_rows] == [tuple(r[k] for k in ck) for r in ct_always.history_rows]


def test_filter_stays_above_the_observation(spark):
    """The accepted-only filter must not be pushed below the scoring
    projection (that would evaluate the models twice per row)."""
    from seedgrow import workloads as W
    from seedgrow.operators.pseudo import confidence_filter
    from seedgrow.plans.base import FEAT, FIRST, ID, replay, tagged_rows

    seed, pool = W.seed_and_pool(spark, SF_SMALL)
    m = nb().fit(seed)
    p = pool.select(F.col("row_id").alias(ID), F.col("features").alias(FEAT), F.lit(True).alias(FIRST))
    df, in_pool, accept, pred = replay(p, [m, m], 0.95, True)
    rows, _ = tagged_rows(df, in_pool, accept, pred, True, keep_pool=False)
    for frame in (rows, confidence_filter(m.transform(pool), 0.95)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        obs_at = next(i for i, line in enumerate(lines) if "CollectMetrics" in line)
        below = "\n".join(lines[obs_at + 1:])
        assert "UDF" not in "".join(line for line in below.splitlines() if "Filter" in line)
