"""Row ids: null and repeated ids are rejected exactly, absent ones generated
once; forests do not depend on the number of cores."""

import subprocess
import sys

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from seedgrow import CoTraining, SelfTraining
from seedgrow.operators import dedup, metrics
from seedgrow.workloads import duplicated_pool, loop_input

SF = "/root/testdata/sf0.001"


def _nb():
    return NaiveBayes(modelType="gaussian")


def _estimators():
    return [SelfTraining(_nb(), threshold=0.95, maxIter=1), CoTraining(_nb(), _nb(), _nb(), threshold=0.9, maxIter=1)]


@pytest.mark.parametrize("which", [0, 1], ids=["self", "co"])
@pytest.mark.parametrize("mode", ["features", "id"])
def test_one_shared_id_is_rejected(spark, which, mode):
    est = _estimators()[which]
    d = loop_input(spark, SF).cache()
    a, b = [r[0] for r in d.where("label is null").orderBy("row_id").limit(2).select("row_id").collect()]
    bad = d.withColumn("row_id", F.when(F.col("row_id") == b, F.lit(a)).otherwise(F.col("row_id")))
    with pytest.raises(ValueError, match="not a unique row id"):
        est.setMatchMode(mode).fit(bad)


@pytest.mark.parametrize("mode", ["features", "id"])
def test_one_null_id_is_rejected(spark, mode):
    d = loop_input(spark, SF)
    low = d.where("label is null").agg(F.min("row_id")).first()[0]
    bad = d.withColumn("row_id", F.when(F.col("row_id") != low, F.col("row_id")))
    with pytest.raises(ValueError, match="null in 1 rows"):
        SelfTraining(_nb(), maxIter=1, matchMode=mode).fit(bad)


def test_absent_id_after_a_shuffle_gives_the_same_loop(spark):
    seed, pool = duplicated_pool(spark, SF)
    d = seed.unionByName(pool.withColumn("label", F.lit(None).cast("double")))
    with_ids = SelfTraining(_nb(), threshold=0.95, maxIter=2).fit(d)
    without = SelfTraining(_nb(), threshold=0.95, maxIter=2).fit(d.drop("row_id").repartition(5, "features"))
    pick = lambda m: [(r["n_labeled"], r["n_unlabeled"], r["n_new"]) for r in m.history_rows]
    assert pick(with_ids) == pick(without)


def test_first_copies_do_not_multiply_rows_with_shared_ids(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(1, Vectors.dense(1.0)), (1, Vectors.dense(2.0)), (None, Vectors.dense(3.0)), (4, Vectors.dense(1.0))]
    out = dedup.mark_first_copies(spark.createDataFrame(rows, ["row_id", "features"]))
    got = sorted((r["features"][0], r["row_id"] or 0, r["is_first"]) for r in out.collect())
    assert got == [(1.0, 1, True), (1.0, 4, False), (2.0, 1, True), (3.0, 0, True)]


def test_nan_scores_count_as_neither_and_one_class_has_null_rates(spark):
    d = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (1.0, float("nan")), (0.0, None)], "label double, score double")
    r = metrics.auc(d).first()
    assert (r["auc"], r["n_pos"], r["n_neg"]) == (1.0, 1, 1)
    one = metrics.roc_curve(d.where("label = 1")).where("threshold is not null").collect()
    assert [(x["fpr"], x["tpr"]) for x in one] == [(None, 1.0)]
    assert metrics.auc(d.where("label = 1")).first()["auc"] is None


def test_library_needs_a_checkpoint_folder():
    from types import SimpleNamespace

    from seedgrow.plans.lineage import checkpoint_root

    bare = SimpleNamespace(
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d=None: d)
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(bare)


def _root():
    import os

    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_forests_do_not_depend_on_the_cores():
    code = (
        "import sys, hashlib, __spark_entry__ as e\n"
        "from seedgrow.session import local_session\n"
        "s = local_session(int(sys.argv[1]), 8)\n"
        "for k in ('supervised_rf', 'selftraining_rf'):\n"
        f"    rows = sorted(map(tuple, e.queries()[k](s, {SF!r}).collect()))\n"
        "    print(k, hashlib.md5(repr(rows).encode()).hexdigest())\n"
    )
    runs = [
        subprocess.run([sys.executable, "-c", code, n], capture_output=True, text=True, cwd=_root(), timeout=600).stdout
        for n in ("2", "4", "8")
    ]
    assert runs[0].count("\n") == 2 and runs[0] == runs[1] == runs[2]
