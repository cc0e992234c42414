"""Self-Training.

::

    L, U ; iter = 0 ; new = 1
    while iter < maxIter and |U| > 0 and new > 0:
        fit base on L
        N = {(argmax label, x) : x in U, max prob > threshold}
        U = U EXCEPT N.features   (distinct in ``features`` mode)
        L = L UNION ALL N
    final = base.fit(L)

Pseudo-labels are never revised. In ``features`` mode the first pool
shrink also de-duplicates the pool by vector (set difference), so from
iteration 2 on only the first copy of each vector is still in the pool;
scoring is a pure function of the vector, so all copies are accepted
together in iteration 1.

Per iteration: one distributed fit on the seed plus the accepted rows so
far, then one map-only pass over the pool's base table that replays the
earlier models to know which rows are still in the pool (``base.replay``),
counts the outcome through an observation and writes the newly accepted
rows; when the pool has shrunk enough, the same pass also writes the rows
still in it as the new base (``base.ReplayPool``).
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from seedgrow.plans.base import (
    ACCEPTED,
    FEAT,
    FIRST,
    ID,
    IT,
    PS,
    STATE,
    Y,
    ReplayPool,
    SemiSupervisedMarker,
    Timer,
    _LoopParams,
    check_base,
    fit_learner,
    make_model,
    prepare_run,
)

HISTORY_SCHEMA = "iteration int, n_labeled long, n_unlabeled long, n_new long, fit_s double, score_s double"


class SelfTraining(Estimator, _LoopParams, SemiSupervisedMarker):
    threshold = Param(
        Params._dummy(), "threshold", "accept a pseudo-label when the top class probability is strictly above this",
        typeConverter=TypeConverters.toFloat,
    )

    def __init__(self, base, threshold: float = 0.95, maxIter: int = 10, featuresCol: str = "features",
                 labelCol: str = "label", idCol: str = "row_id", matchMode: str = "features"):
        super().__init__()
        check_base(base)
        self.base = base
        self._setDefault(threshold=0.95)
        self._set(threshold=threshold, maxIter=maxIter, featuresCol=featuresCol, labelCol=labelCol,
                  idCol=idCol, matchMode=matchMode)

    def getThreshold(self) -> float:
        return self.getOrDefault(self.threshold)

    def setThreshold(self, value: float):
        return self._set(threshold=value)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.base = self.base.copy()
        return that

    def _fit(self, dataset):
        t = self.getThreshold()
        if not 0.0 <= t <= 1.0:
            raise ValueError("threshold must be in [0, 1]")
        dedup = self.getMatchMode() == "features"
        spark = dataset.sparkSession
        ws, run = self.open_run(spark, "selftraining")
        with ws.ending(run.named):
            prep = prepare_run(self, dataset, ws, run, dedup)
            seed = prep.seed
            schema = (
                prep.table.select(ID, FEAT, FIRST).schema.add(PS, DoubleType()).add(IT, IntegerType())
                .add(STATE, StringType())
            )

            def written():
                return ws.read("st", schema)

            def accepted(done: int):
                # Bounded, as an interrupted run may have left a part of the next one.
                return written().where((F.col(STATE) == ACCEPTED) & (F.col(IT) <= done)).select(FEAT, F.col(PS).alias(Y))

            pool = ReplayPool(prep.pool, prep.n_pool, t, dedup, self.getOrDefault(self.compactRatio),
                              self.getOrDefault(self.maxChain))
            n_lab = prep.n_seed
            history: list[dict] = []
            it, new = 0, 1
            past = run.iterations
            if past:
                history = [p["history"] for p in past]
                it, new, n_lab = len(past), history[-1]["n_new"], history[-1]["n_labeled"]
                pool.restore(
                    [(f"st/{IT}={k}", p["history"]["n_unlabeled"], p["compacted"], lambda k=k: run.model(k, f"model/{k}"))
                     for k, p in enumerate(past, 1)],
                    lambda rel: written().where(F.col(IT) == int(rel.rsplit("=", 1)[1])),
                )
            while it < self.getMaxIter() and pool.n_left > 0 and new > 0:
                it += 1
                clock = Timer()
                train = seed if it == 1 else seed.unionByName(accepted(it - 1))
                model = fit_learner(self.base, train, num_classes=prep.num_classes)
                fit_s = clock.lap()
                k = it
                new = pool.step(model, ws, f"st/{IT}={it}", lambda rel, k=k: written().where(F.col(IT) == k))
                n_lab += new
                history.append(dict(iteration=it, n_labeled=n_lab, n_unlabeled=pool.n_left, n_new=new,
                                    fit_s=fit_s, score_s=clock.lap()))
                run.complete(history[-1], {f"model/{it}": model}, compacted=pool.compacted)
                self.log_iteration(history[-1])
            final_train = seed if it == 0 else seed.unionByName(accepted(it))
            final = fit_learner(self.base, final_train, num_classes=prep.num_classes)
        return make_model(self, final, prep, history, HISTORY_SCHEMA)
