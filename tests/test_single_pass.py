"""Inputs are evaluated once per fit; many models are scored and measured in
one pass; running sums over ranges are exact."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from seedgrow import CoTraining, HardEM, SelfTraining
from seedgrow.operators import metrics, prefix
from seedgrow.plans.evaluate import evaluate_all, score_models
from seedgrow.plans.lineage import Workspace
from seedgrow.plans.supervised import Supervised


def counted(df, spark):
    """``df`` and an accumulator of the rows that any job evaluates."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def touch(x):
        seen.add(1)
        return x

    return df.withColumn("label", touch.asNondeterministic()("label")), seen


def samples(spark, n=60):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 2, 0.4), rng.gauss(0, 1)], 1.0 if i % 2 else -1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>, label double")
    return df.select("row_id", array_to_vector("x").alias("features"), "label")


@pytest.mark.parametrize("learner", ["nb", "lr"])
def test_supervised_reads_its_input_once(spark, learner):
    df, seen = counted(samples(spark), spark)
    base = NaiveBayes(modelType="gaussian") if learner == "nb" else LogisticRegression(maxIter=5)
    model = Supervised(base).fit(df)
    # Once in the filter on the label and once in the row that is written.
    assert seen.value in (60, 120)
    assert sorted(model.labels) == [-1.0, 1.0]


def test_all_models_are_scored_in_one_scan(spark):
    s = samples(spark)
    models = [(Supervised(NaiveBayes(modelType="gaussian")).fit(s), "a"), (Supervised(LogisticRegression()).fit(s), "b"),
              (Supervised(LogisticRegression(regParam=0.5)).fit(s), "c")]
    df, seen = counted(s, spark)
    got = {(r["name"], r["label"], r["prediction"], r["score"]) for r in score_models(models, df, "label", 1.0).collect()}
    assert seen.value == 60
    for m, name in models:
        alone = m.transform(s).collect()
        at = m.labels.index(1.0)
        assert {(name, r["label"], r["prediction"], round(float(r["probability"][at]), 12)) for r in alone} == {g for g in got if g[0] == name}


def test_metrics_of_many_models_equal_each_alone(spark):
    rng = random.Random(5)
    rows = [(m, None if m == "odd" else k, float(rng.choice([1, -1])), float(rng.choice([1, -1])), rng.choice([None, 0.1, 0.5, rng.random()]))
            for m in ("one", "two", "odd") for k in (1, 2) for _ in range(40)]
    df = spark.createDataFrame(rows, "name string, fold int, label double, prediction double, score double")
    with Workspace(spark, "test") as ws:
        got = {(r["name"], r["fold"]): r for r in metrics.metrics_by(df, ["name", "fold"], ws).collect()}
        assert len(got) == 5
        for (name, fold), r in got.items():
            part = df.where((F.col("name") == name) & F.col("fold").eqNullSafe(F.lit(fold)))
            w, a = metrics.weighted_metrics(part).first(), metrics.auc(part).first()
            for c in ("weighted_precision", "weighted_recall", "weighted_f1", "n"):
                assert r[c] == pytest.approx(w[c])
            for c in ("auc", "auc_folded", "n_pos", "n_neg"):
                assert r[c] == pytest.approx(a[c])


def test_metric_jobs_do_not_depend_on_models(spark):
    """The grouped tables hold all fractions and algorithms at once."""
    b = samples(spark, 120)
    algos = [(Supervised(LogisticRegression(regParam=r)), f"lr{r}") for r in (0.0, 0.1, 0.2)]
    rows = evaluate_all(algos, b, [0.3, 0.4], [42, 43], 1.0).collect()
    assert len(rows) == 6 and all(r["weighted_f1"] > 0.5 for r in rows)
    timed = evaluate_all(algos[:1], b, [0.3], [42], 1.0, with_timing=True).collect()
    assert timed[0]["learning_time_s"] > 0


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_running_sums(spark, ranges):
    rng = random.Random(9)
    keys = rng.sample(range(10_000), 300)
    rows = [(rng.choice(["a", "b", None]), k, rng.randint(0, 9)) for k in keys] + [("a", None, 7)]
    df = spark.createDataFrame(rows, "g string, k int, n bigint")
    with Workspace(spark, "test") as ws:
        out = prefix.running_sums(df, ws, "t", ["k"], ["n"], ["g"], ["k"], ranges).collect()
        # Descending order puts a null key last.
        for r in out:
            group = [x for x in rows if x[0] == r["g"]]
            before = [x for x in group if x[1] is not None and (r["k"] is None or x[1] > r["k"])]
            assert (r["n_before"], r["n_total"]) == (sum(x[2] for x in before), sum(x[2] for x in group))
        places = prefix.positions(df.where("k is not null"), ws, "p", ["k"], [], "at", ranges).collect()
        assert {r["k"]: r["at"] for r in places} == {k: i for i, k in enumerate(sorted(keys))}


def test_roc_plan_has_no_bounds_and_no_forced_broadcast(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") / 7).alias("score"))
    obs = Observation()
    seen = df.observe(obs, F.count(F.lit(1)).alias("n"))
    plan = metrics.score_prefix_counts(seen)._jdf.queryExecution().analyzed().toString()
    assert obs.get["n"] == 1000
    assert "Bucketizer" not in plan and "CASE WHEN (score" not in plan and "ResolvedHint" not in plan


def test_learners_with_a_training_summary_run_in_the_loops(spark):
    """A summary holds the session, which cannot be shipped once it has
    observed a query."""
    s = samples(spark, 120).withColumn("label", F.when(F.col("row_id") % 5 < 2, F.col("label")))
    for est in (SelfTraining(LogisticRegression(), threshold=0.8, maxIter=2), HardEM(LogisticRegression(), maxIter=2),
                CoTraining(LogisticRegression(), LogisticRegression(), LogisticRegression(), threshold=0.6, maxIter=2)):
        model = est.fit(s)
        assert model.transform(s).where("prediction = 1").count() in range(45, 76)
        assert not model.baseModel.hasSummary
