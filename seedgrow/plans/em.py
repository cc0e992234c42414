"""Hard (classification) Expectation-Maximisation.

::

    fit base on L
    iter = 0 ; residual = 100
    while iter < maxIter and |U| > 0 and residual > tolPercent:
        P = predict U with the current model            (E-step)
        fit base on L UNION ALL P                       (M-step)
        missed = #{rows whose predicted label changed}  (|U| in iteration 0)
        residual = 100 * missed / |U|
    P = predict U with the last model ; final = base.fit(L UNION ALL P)

Hard assignments, no weights, no threshold; ``L`` stays the original
labelled rows and every E-step relabels the whole pool.

Each E-step is one pass: it scores every pool row once, writes its label beside
its features and, reading the labels of the E-step before from the same rows,
counts the changed ones through an observation — no join, no driver arrays, no
positional matching. All passes of the M-step's learner read the written
labels. Only the tables of the last two E-steps stay.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import functions as F

from seedgrow.plans.base import (
    FEAT,
    Y,
    SemiSupervisedMarker,
    Timer,
    _LoopParams,
    check_base,
    fit_learner,
    make_model,
    prepare_run,
)

HISTORY_SCHEMA = "iteration int, residual_pct double, n_changed long, n_labeled long, n_unlabeled long, step_s double"


def predict_with(model, df, out: str):
    return model.transform(
        df,
        {model.featuresCol: FEAT, model.predictionCol: out, model.probabilityCol: f"{out}_p",
         model.rawPredictionCol: f"{out}_r"},
    )


class HardEM(Estimator, _LoopParams, SemiSupervisedMarker):
    tolPercent = Param(
        Params._dummy(), "tolPercent", "stop when at most this percent of pool labels changed",
        typeConverter=TypeConverters.toFloat,
    )

    def __init__(self, base, tolPercent: float = 10.0, maxIter: int = 10, featuresCol: str = "features",
                 labelCol: str = "label", idCol: str = "row_id"):
        super().__init__()
        check_base(base)
        self.base = base
        self._setDefault(tolPercent=10.0)
        # EM never removes rows from the pool: no set difference, duplicates stay.
        self._set(tolPercent=tolPercent, maxIter=maxIter, featuresCol=featuresCol, labelCol=labelCol,
                  idCol=idCol, matchMode="id")

    def getTolPercent(self) -> float:
        return self.getOrDefault(self.tolPercent)

    def setTolPercent(self, value: float):
        return self._set(tolPercent=value)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.base = self.base.copy()
        return that

    def _fit(self, dataset):
        tol = self.getTolPercent()
        spark = dataset.sparkSession
        ws, run = self.open_run(spark, "em")
        with ws.ending(run.named):
            prep = prepare_run(self, dataset, ws, run, dedup=False)
            seed = prep.seed
            k = prep.num_classes
            n_pool = prep.n_pool
            history: list[dict] = []
            scored: list[int] = []
            unlabeled = prep.pool.select(FEAT, F.lit(None).cast("double").alias(Y))

            def e_step(model, rows, step: int):
                """Label ``rows`` with ``model``; ``(labelled rows, changed)``."""
                cur = predict_with(model, rows, "__cur")
                changed = F.when(F.col(Y).isNotNull() & (F.col(Y) != F.col("__cur")), 1).otherwise(0).cast("long")
                both = cur.select(FEAT, F.col("__cur").cast("double").alias(Y), changed.alias("__changed"))
                m = ws.write(both, f"e/step={step}", metrics=[F.sum("__changed").alias("changed"), F.count(F.lit(1)).alias("n")])
                scored.append(int(m["n"]))
                if step > 1:
                    # The one before is read until this step is complete.
                    ws.delete(f"e/step={step - 2}")
                return ws.read(f"e/step={step}", both.schema).select(FEAT, Y), int(m.get("changed") or 0)

            rows, it, residual = unlabeled, len(run.iterations), 100.0
            if it:
                history = [p["history"] for p in run.iterations]
                residual = history[-1]["residual_pct"]
                model = run.model(it, f"model/{it}")
                rows = ws.read(f"e/step={it - 1}", prep.pool.select(FEAT).schema.add(Y, "double"))
            else:
                model = fit_learner(self.base, seed, num_classes=k)
            last = model
            if n_pool > 0:
                while it < self.getMaxIter() and residual > tol:
                    clock = Timer()
                    rows, n_changed = e_step(model, rows, it)
                    model = fit_learner(self.base, seed.unionByName(rows), num_classes=k)
                    missed = n_pool if it == 0 else n_changed
                    residual = 100.0 * missed / n_pool
                    it += 1
                    history.append(dict(iteration=it, residual_pct=residual, n_changed=n_changed,
                                        n_labeled=prep.n_seed, n_unlabeled=n_pool, step_s=clock.lap()))
                    run.complete(history[-1], {f"model/{it}": model})
                    self.log_iteration(history[-1])
                last = model
                rows, _ = e_step(model, rows, it)
                model = fit_learner(self.base, seed.unionByName(rows), num_classes=k)
        out = make_model(self, model, prep, history, HISTORY_SCHEMA)
        # The model whose E-step produced the final training set's pseudo-labels.
        out.loopModel = last
        # Rows scored by each E-step.
        out.scoredRows = scored
        return out
