"""Checkpoint folder handling and the per-fit workspace."""

import os

from seedgrow.plans.lineage import Workspace, checkpoint_root
from seedgrow.session import ensure_checkpoint_dir


def test_existing_checkpoint_dir_is_kept(spark):
    before = checkpoint_root(spark)
    assert ensure_checkpoint_dir(spark, "/nonexistent/should-not-be-used") == before


def test_workspace_write_observe_read_delete(spark):
    from pyspark.sql import functions as F

    ws = Workspace(spark, "unit")
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    m = ws.write(df, "t", partition_by=["k"], metrics=[F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")])
    assert m == {"n": 100, "s": 4950}
    assert ws.read("t").count() == 100
    local = ws.root.replace("file:", "")
    assert os.path.isdir(local)
    ws.close()
    assert not os.path.exists(local)


def test_roc_for_writes_curve(spark, tmp_path):
    from pyspark.ml.classification import NaiveBayes

    from seedgrow.plans.evaluate import roc_for
    from seedgrow.plans.supervised import Supervised
    from seedgrow.sources import binary_embedding_samples

    b = binary_embedding_samples(spark, "/root/testdata/sf0.001")
    roc = roc_for(Supervised(NaiveBayes(modelType="gaussian")), b, 0.3, 42, 1.0, path=str(tmp_path / "roc"))
    assert spark.read.parquet(str(tmp_path / "roc")).count() == roc.count() > 2
