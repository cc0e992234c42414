"""Operator edge cases on inline tables, and metrics against MLlib."""

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import vec_df, SF_MID
from seedgrow.functions import as_array, slice_vector, unit_hash
from seedgrow.operators import dedup, indexing, metrics, setops, splits
from seedgrow.plans.supervised import Supervised
from seedgrow.sources import good_lines, parse_labeled_lines, quality_samples, read_labeled_text, rejected_lines
from seedgrow.sources.sinks import write_results, write_roc


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parser_reasons(spark):
    df = parse_labeled_lines(
        lines(spark, ["1,2 3", "-1,4 5 ", "1 2 3", "x,1 2", "1,", "1,2  3", "1,2 a", "2,7,ignored"])
    )
    good = [(r["label"], list(r["features"])) for r in good_lines(df).collect()]
    assert good == [(1.0, [2.0, 3.0]), (-1.0, [4.0, 5.0]), (2.0, [7.0])]
    reasons = sorted(r["reject_reason"] for r in rejected_lines(df).collect())
    assert reasons == ["bad_label", "blank_field", "no_comma", "no_features", "not_a_number"]


def test_parser_strict_mode_fails(spark):
    with pytest.raises(Exception, match="unparseable line"):
        parse_labeled_lines(lines(spark, ["1,2 3", "oops"]), mode="strict").collect()
    assert parse_labeled_lines(lines(spark, ["1,2 3"]), mode="strict").count() == 1


def test_read_text_file(spark, tmp_path):
    p = tmp_path / "data.txt"
    p.write_text("1,0.5 2\n-1,3 4\nbad\n")
    df = read_labeled_text(spark, str(p))
    assert good_lines(df).count() == 2 and rejected_lines(df).count() == 1


def test_slice_repeats_and_order(spark):
    df = vec_df(spark, [(Vectors.dense([10.0, 11.0, 12.0]),)], "features vector")
    out = df.select(as_array(slice_vector("features", [2, 0, 2])).alias("a")).first()["a"]
    assert out == [12.0, 10.0, 12.0]
    with pytest.raises(ValueError):
        slice_vector("features", [])


def test_dense_and_sparse_twins_match(spark):
    pool = vec_df(
        spark,
        [(1, Vectors.dense([0.0, 1.0])), (2, Vectors.sparse(2, {1: 1.0})), (3, Vectors.dense([2.0, 0.0]))],
        "row_id long, features vector",
    )
    acc = vec_df(spark, [(9, Vectors.sparse(2, {0: 2.0}))], "row_id long, features vector")
    left = sorted(r["row_id"] for r in setops.pool_except(pool, acc).collect())
    assert left == [1]
    s = dedup.duplicate_summary(pool).first()
    assert (s["n_rows"], s["n_distinct"]) == (3, 2)


def test_label_index_tie_break(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "label string")
    assert indexing.frequency_labels(df, "label") == ["c", "a", "b"]
    labels, identity = indexing.resolve_labels(
        spark.createDataFrame([(1.0,), (0.0,), (0.0,)], "label double"), "label"
    )
    assert identity and labels == [0.0, 1.0]


def test_split_is_nested_and_deterministic(spark):
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    a = splits.stratified_split(df, 0.1, 42).where("is_labeled").select("row_id")
    b = splits.stratified_split(df.repartition(7), 0.2, 42).where("is_labeled").select("row_id")
    assert a.subtract(b).count() == 0
    assert a.count() == splits.stratified_split(df.repartition(3), 0.1, 42).where("is_labeled").count()


def test_sweep_fractions():
    assert splits.sweep_fractions() == [0.12, 0.125, 0.13, 0.135, 0.145, 0.155, 0.165, 0.175, 0.185, 0.195]


def test_metrics_match_mllib(spark):
    q = quality_samples(spark, SF_MID).where("label IS NOT NULL")
    flag = unit_hash("row_id", 42) < 0.34
    model = Supervised(NaiveBayes(modelType="gaussian")).fit(q.where(flag))
    pred = model.transform(q.where(~flag))
    w = metrics.weighted_metrics(pred).first()
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    for name, col in (("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall"), ("f1", "weighted_f1")):
        assert w[col] == pytest.approx(ev.setMetricName(name).evaluate(pred), abs=1e-12)
    scores = pred.select("label", as_array("probability")[1].alias("score"))
    exact = metrics.auc(scores, "label", "score").first()
    bce = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", numBins=0)
    assert exact["auc"] == pytest.approx(bce.evaluate(pred), abs=1e-12)


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5), (1.0, 0.9), (0.0, 0.1)], "label double, score double")
    assert metrics.auc(df, buckets=2).first()["auc"] == pytest.approx((1 + 0.5 + 1 + 1) / 4)
    one = spark.createDataFrame([(1.0, 0.5), (1.0, 0.7)], "label double, score double")
    assert metrics.auc(one).first()["auc"] is None


def test_auc_bucketing_is_exact(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3 == 0).cast("double").alias("label"), (F.col("id") % 101 / 100.0).alias("score")
    )
    ref = metrics.auc(df, buckets=1).first()["auc"]
    for b in (2, 7, 64):
        assert metrics.auc(df, buckets=b).first()["auc"] == pytest.approx(ref, abs=1e-15)
    roc = metrics.roc_curve(df, buckets=16)
    assert roc.count() == 101 + 2
    assert roc.where("threshold IS NOT NULL").agg(F.max("tpr"), F.max("fpr")).first() == (1.0, 1.0)


def test_sinks_round_trip(spark, tmp_path):
    res = spark.createDataFrame([("A", 0.1, 0.5), ("B", 0.1, 0.6)], "name string, label_fraction double, auc double")
    write_results(res, str(tmp_path / "res"))
    back = spark.read.parquet(str(tmp_path / "res"))
    assert sorted(r["name"] for r in back.collect()) == ["A", "B"]
    roc = spark.createDataFrame([(None, 0.0, 0.0), (0.5, 0.5, 1.0)], "threshold double, fpr double, tpr double")
    write_roc(roc, str(tmp_path / "roc"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "roc")).count() == 2


def test_sweep_end_to_end(spark, tmp_path):
    from pyspark.ml.classification import NaiveBayes

    from seedgrow.plans.selftraining import SelfTraining
    from seedgrow.plans.sweep import run_sweep
    from seedgrow.plans.supervised import Supervised
    from seedgrow.sources import binary_embedding_samples

    b = binary_embedding_samples(spark, "/root/testdata/sf0.001")
    lines = b.select(
        F.concat(F.col("label").cast("int").cast("string"), F.lit(","),
                 F.array_join(as_array("features").cast("array<string>"), " ")).alias("value")
    )
    lines.write.text(str(tmp_path / "in"))
    algos = [(Supervised(NaiveBayes(modelType="gaussian")), "NB"),
             (SelfTraining(NaiveBayes(modelType="gaussian"), maxIter=1), "ST")]
    out = run_sweep(spark, str(tmp_path / "in"), str(tmp_path / "out"), [0.2, 0.3], [42], 1.0, algos)
    rows = out.collect()
    assert len(rows) == 4 and {r["name"] for r in rows} == {"NB", "ST"}
    assert all(0.0 <= r["weighted_f1"] <= 1.0 and r["learning_time_s"] > 0 for r in rows)


def test_inductive_evaluation(spark):
    from pyspark.ml.classification import NaiveBayes

    from seedgrow.plans.evaluate import evaluate_all
    from seedgrow.plans.selftraining import SelfTraining
    from seedgrow.sources import binary_embedding_samples

    b = binary_embedding_samples(spark, "/root/testdata/sf0.001")
    algos = [(SelfTraining(NaiveBayes(modelType="gaussian"), maxIter=1), "ST")]
    trans = evaluate_all(algos, b, [0.2], [42]).first()
    induc = evaluate_all(algos, b, [0.2], [42], test_fraction=0.3).first()
    assert 0.0 <= induc["weighted_f1"] <= 1.0 and 0.0 <= trans["weighted_f1"] <= 1.0
