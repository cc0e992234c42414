"""Forest queries: the saved trees, walked node by node, give the model's
predictions, for every algorithm."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from seedgrow import CoTraining, HardEM, SelfTraining
from seedgrow.operators import splits
from seedgrow.plans.supervised import Supervised
from seedgrow.workloads import FRACTION, SEED, documents_indexed

SF = "/root/testdata/sf0.001"


def rf(seed=7):
    return RandomForestClassifier(numTrees=15, seed=seed)


ALGORITHMS = {
    "supervised": lambda: Supervised(rf()),
    "self": lambda: SelfTraining(rf(), threshold=0.95, maxIter=3),
    "em": lambda: HardEM(rf(), tolPercent=3.0, maxIter=7),
    "co": lambda: CoTraining(rf(1), rf(2), rf(3), threshold=0.90, maxIter=3),
}


def probabilities(nodes, x):
    """Sum over the trees of the class shares in the leaf that ``x`` reaches."""
    total = None
    for tree in nodes.values():
        n = tree[0]
        while n["leftChild"] >= 0:
            low = x[n["split"]["featureIndex"]] <= n["split"]["leftCategoriesOrThreshold"][0]
            n = tree[n["leftChild"] if low else n["rightChild"]]
        share = [v / sum(n["impurityStats"]) for v in n["impurityStats"]]
        total = share if total is None else [a + b for a, b in zip(total, share)]
    return total


@pytest.mark.parametrize("kind", list(ALGORITHMS))
def test_saved_trees_give_the_predictions(spark, tmp_path, kind):
    docs, _ = documents_indexed(spark, SF)
    docs = docs.cache()
    model = ALGORITHMS[kind]().fit(splits.semi_supervised_input(docs, FRACTION, SEED))
    model.baseModel.write().save(str(tmp_path / "model"))
    rows = spark.read.parquet(str(tmp_path / "model" / "data"))
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    nodes = {}
    for r in rows.collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    assert len(nodes) == 15
    for r in model.transform(docs).select("features", "prediction", "probability", F.col("row_id")).collect():
        p = probabilities(nodes, r["features"].toArray())
        assert list(r["probability"]) == pytest.approx([v / sum(p) for v in p])
        assert r["prediction"] == model.labels[max(range(len(p)), key=lambda i: p[i])]
    docs.unpersist()
