"""State of the loops: kept results are removed on release, interrupted runs
go on from their manifest, failed overwrites leave the old table."""

import os

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from seedgrow import CoTraining, HardEM, SelfTraining
from seedgrow.operators import metrics
from seedgrow.plans import base, lineage
from seedgrow.plans.lineage import checkpoint_root, release, releasing
from seedgrow.sources import sinks
from seedgrow.workloads import loop_input

SF = "/root/testdata/sf0.001"


def nb():
    return NaiveBayes(modelType="gaussian")


def folders(spark):
    root = checkpoint_root(spark).replace("file:", "")
    return {f for f in os.listdir(root) if f.startswith("seedgrow-")}


def plain(rows):
    return [{k: v for k, v in r.items() if not k.endswith("_s")} for r in rows]


LOOPS = {
    "self": lambda: SelfTraining(nb(), threshold=0.9, maxIter=4).setMaxChain(2),
    "self-id": lambda: SelfTraining(nb(), threshold=0.9, maxIter=4, matchMode="id"),
    "em": lambda: HardEM(nb(), tolPercent=0.0, maxIter=4),
    "co": lambda: CoTraining(nb(), nb(), nb(), threshold=0.5, maxIter=4),
}


@pytest.mark.parametrize("kind", list(LOOPS))
def test_killed_fit_resumes_from_its_manifest(spark, monkeypatch, kind):
    before = folders(spark)
    whole = LOOPS[kind]().fit(loop_input(spark, SF))
    done = lineage.Run.complete
    reads = []

    def killed(self, history, models, **more):
        done(self, history, models, **more)
        if len(self.iterations) == 2:
            raise KeyboardInterrupt("driver lost")

    est = LOOPS[kind]().setRunName(f"test-{kind}")
    monkeypatch.setattr(lineage.Run, "complete", killed)
    with pytest.raises(KeyboardInterrupt):
        est.fit(loop_input(spark, SF))
    monkeypatch.setattr(lineage.Run, "complete", done)
    assert len(folders(spark) - before) == 1
    prepare = base.prepare
    monkeypatch.setattr(base, "prepare", lambda *a, **k: reads.append(1) or prepare(*a, **k))
    resumed = est.fit(loop_input(spark, SF))
    assert not reads and folders(spark) == before
    assert plain(resumed.history_rows) == plain(whole.history_rows) and len(whole.history_rows) > 2
    a, b = (m.transform(loop_input(spark, SF)).select("row_id", "prediction").orderBy("row_id").collect() for m in (whole, resumed))
    assert a == b


def test_named_run_rejects_other_settings(spark, monkeypatch):
    est = SelfTraining(nb(), threshold=0.9, maxIter=3).setRunName("other")
    monkeypatch.setattr(lineage.Run, "complete", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(RuntimeError):
        est.fit(loop_input(spark, SF))
    with pytest.raises(ValueError, match="other settings"):
        SelfTraining(nb(), threshold=0.8, maxIter=3).setRunName("other").fit(loop_input(spark, SF))
    lineage.Workspace(spark, "selftraining", name="other").delete()


def test_kept_results_go_on_release(spark):
    release(spark)
    before = folders(spark)
    df = spark.range(50).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") / 3).alias("score"))
    roc = metrics.roc_curve(df)
    assert roc.count() == 52 and len(folders(spark) - before) == 1
    with releasing(spark):
        assert metrics.auc(df).first()["n_pos"] == 25
        assert len(folders(spark) - before) == 2
    assert len(folders(spark) - before) == 1
    assert release(spark) == 1 and folders(spark) == before


def test_each_e_step_scores_every_pool_row_once(spark):
    m = HardEM(nb(), tolPercent=0.0, maxIter=3).fit(loop_input(spark, SF))
    n = loop_input(spark, SF).where("label is null").count()
    assert m.scoredRows == [n] * (len(m.history_rows) + 1)


def test_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_table(spark.range(5), path)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        sinks.write_table(bad, path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["table"]
    sinks.write_table(spark.read.parquet(path).where("id < 2"), path)
    assert spark.read.parquet(path).count() == 2 and os.listdir(tmp_path) == ["table"]


def test_overwrite_restores_a_table_left_aside(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_table(spark.range(5), path)
    os.rename(path, path + ".__old")  # a crash between the two renames
    with pytest.raises(Exception):
        sinks.write_table(spark.range(3).select(F.raise_error(F.lit("x")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5


def test_set_operations_shuffle_digests_only(spark):
    from seedgrow.operators import dedup, setops

    d = loop_input(spark, SF).where("label is null")
    seed = loop_input(spark, SF).where("label is not null")
    with_label = seed.select("row_id", "label", "features")
    for df in (setops.pool_except(d, d.limit(10)), dedup.mark_first_copies(d), setops.agreement(with_label, with_label)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "hashpartitioning(" in x]
        assert keys and all("__d1" in k and "vec" not in k and "__f" not in k for k in keys), keys


def test_vectors_that_share_a_digest_are_not_merged(spark, monkeypatch):
    from seedgrow.operators import setops

    monkeypatch.setattr(setops, "vector_digest", lambda arr: [F.lit(1).cast("long").alias("__d1"), F.lit(2).cast("long").alias("__d2")])
    with pytest.raises(Exception, match="share a 128-bit digest"):
        setops.distinct_vectors(loop_input(spark, SF)).collect()


def test_fifty_thousand_labels_round_trip(spark):
    from seedgrow.operators import indexing

    n = 50_000
    df = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("copy"), F.concat(F.lit("label "), "id").alias("label"))
    df = df.unionByName(spark.createDataFrame([(0, None)], "copy int, label string"))
    with releasing(spark):
        d = indexing.label_index_table(df, "label")
        back = indexing.with_label(indexing.with_label_index(df, d, "label"), d, "label_index", "back").cache()
        assert back.count() == df.count()
        assert back.where(~F.col("back").eqNullSafe(F.col("label"))).count() == 0
        assert back.where("label is null and label_index is null").count() == 1
        rows = d.orderBy("label_index").collect()
        want = sorted(((f"label {i}", i % 3 + 1) for i in range(n)), key=lambda r: (-r[1], r[0]))
        assert [(r["label"], r["n"]) for r in rows] == want
        assert [r["label_index"] for r in rows] == [float(i) for i in range(n)]
        back.unpersist()


def test_label_lists_of_any_length_are_one_literal(spark):
    from seedgrow.functions.labels import index_of_label, label_of_index

    for labels in ([float(2 * i - 7) for i in range(20_000)], [f'a "{i}"\n\\ é' for i in range(50)], [3, 1, 2]):
        kind = "string" if isinstance(labels[0], str) else "double" if isinstance(labels[0], float) else "int"
        df = spark.createDataFrame([(v,) for v in labels[:50]] + [(None,)], f"label {kind}")
        got = df.select("label", index_of_label("label", labels).alias("i")).withColumn("back", label_of_index("i", labels)).collect()
        assert [(r["i"], r["back"]) for r in got] == [(float(i), v) for i, v in enumerate(labels[:50])] + [(None, None)]
