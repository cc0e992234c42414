"""Co-Training over two feature views.

::

    views V1, V2 (default: first and second half of the positions)
    L1 = L2 = L ; U1 = U2 = U
    iter = 1 ; new = 1
    while iter <= maxIter and |U1| > 0 and |U2| > 0 and new > 0:
        fit base1 on V1(L1) ; fit base2 on V2(L2)
        N1 = reliable(U1 scored through V1) ; N2 = reliable(U2 scored through V2)
        L1 = L1 UNION ALL N2 ; L2 = L2 UNION ALL N1     (cross-teaching)
        U1 = U1 EXCEPT N1 ; U2 = U2 EXCEPT N2
    final = finalBase.fit(L1 INTERSECT L2)             (all features)

The agreement set holds the distinct original rows plus the rows both
learners accepted with the same label (maybe in different iterations).

Each learner writes the rows it accepts under ``learner=k/it=i/state=acc``:
L1 is the seed plus learner 2's directories. Learner k's pool is its base
table with learner k's earlier models replayed (``base.ReplayPool``); the
base is rewritten only when the pool has shrunk enough (compaction). Views are column expressions evaluated during
the scan, never stored. The two learners' fits and scoring passes are
independent jobs and run concurrently from two driver threads.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from seedgrow.functions.vectors import slice_vector
from seedgrow.operators.setops import agreement
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
    run_parallel,
)

VIEW = "__view"
LEARNER = "learner"
HISTORY_SCHEMA = (
    "iteration int, n_new1 long, n_new2 long, n_labeled1 long, n_labeled2 long, "
    "n_unlabeled1 long, n_unlabeled2 long, n_agreement long, step_s double"
)


def default_views(dim: int) -> tuple[list[int], list[int]]:
    """First half ``[0, dim/2)`` and second half ``[dim/2, dim)``."""
    if dim < 2:
        raise ValueError(f"co-training needs at least two features for the default views, got {dim}")
    half = dim // 2
    return list(range(half)), list(range(half, dim))


def _check_view(view: list[int], dim: int, name: str) -> list[int]:
    if not view:
        raise ValueError(f"{name} is empty")
    bad = [i for i in view if i < 0 or i >= dim]
    if bad:
        raise ValueError(f"{name} has positions outside [0, {dim}): {bad}")
    return [int(i) for i in view]


class CoTraining(Estimator, _LoopParams, SemiSupervisedMarker):
    threshold = Param(Params._dummy(), "threshold", "acceptance threshold on the top class probability",
                      typeConverter=TypeConverters.toFloat)
    view1Indices = Param(Params._dummy(), "view1Indices", "feature positions of view 1 (any order, repeats allowed)",
                         typeConverter=TypeConverters.toListInt)
    view2Indices = Param(Params._dummy(), "view2Indices", "feature positions of view 2",
                         typeConverter=TypeConverters.toListInt)
    parallelism = Param(Params._dummy(), "parallelism", "concurrent driver threads for the two learners",
                        typeConverter=TypeConverters.toInt)
    trackAgreement = Param(Params._dummy(), "trackAgreement", "count the agreement set after every iteration",
                           typeConverter=TypeConverters.toBoolean)

    def __init__(self, base1, base2=None, final=None, threshold: float = 0.95, maxIter: int = 10,
                 view1Indices=None, view2Indices=None, featuresCol: str = "features", labelCol: str = "label",
                 idCol: str = "row_id", matchMode: str = "features", parallelism: int = 2,
                 trackAgreement: bool = False):
        super().__init__()
        base2 = base2 if base2 is not None else base1.copy()
        final = final if final is not None else base1.copy()
        for b in (base1, base2, final):
            check_base(b)
        self.base1, self.base2, self.final = base1, base2, final
        self._setDefault(threshold=0.95, parallelism=2, trackAgreement=False)
        self._set(threshold=threshold, maxIter=maxIter, featuresCol=featuresCol, labelCol=labelCol, idCol=idCol,
                  matchMode=matchMode, parallelism=parallelism, trackAgreement=trackAgreement)
        if view1Indices is not None:
            self._set(view1Indices=view1Indices)
        if view2Indices is not None:
            self._set(view2Indices=view2Indices)

    def setViews(self, view1, view2):
        return self._set(view1Indices=view1, view2Indices=view2)

    def setView1Indices(self, value):
        return self._set(view1Indices=value)

    def setView2Indices(self, value):
        return self._set(view2Indices=value)

    def setThreshold(self, value: float):
        return self._set(threshold=value)

    def getThreshold(self) -> float:
        return self.getOrDefault(self.threshold)

    def setParallelism(self, value: int):
        return self._set(parallelism=value)

    def setTrackAgreement(self, value: bool):
        return self._set(trackAgreement=value)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.base1, that.base2, that.final = self.base1.copy(), self.base2.copy(), self.final.copy()
        return that

    def _views(self, dim: int) -> tuple[list[int], list[int]]:
        v1 = self.getOrDefault(self.view1Indices) if self.isDefined(self.view1Indices) else None
        v2 = self.getOrDefault(self.view2Indices) if self.isDefined(self.view2Indices) else None
        if v1 is None or v2 is None:
            d1, d2 = default_views(dim)
            v1 = v1 if v1 is not None else d1
            v2 = v2 if v2 is not None else d2
        return _check_view(list(v1), dim, "view1Indices"), _check_view(list(v2), dim, "view2Indices")

    def _fit(self, dataset):
        t = self.getOrDefault(self.threshold)
        mode = self.getMatchMode()
        dedup = mode == "features"
        par = self.getOrDefault(self.parallelism)
        track = self.getOrDefault(self.trackAgreement)
        spark = dataset.sparkSession
        ws, run = self.open_run(spark, "cotraining")
        with ws.ending(run.named):
            prep = prepare_run(self, dataset, ws, run, dedup)
            v1, v2 = self._views(int(prep.max_dim or 0))
            views = {1: v1, 2: v2}
            learners = {1: self.base1, 2: self.base2}
            seed = prep.seed
            k_classes = prep.num_classes
            schema = (
                prep.table.select(ID, FEAT, FIRST).schema.add(PS, DoubleType()).add(LEARNER, IntegerType())
                .add(IT, IntegerType()).add(STATE, StringType())
            )

            def written():
                return ws.read("ct", schema)

            def accepted_by(learner: int, it_done: int, with_ids: bool = False):
                # Bounded by iteration: the other learner may be writing the
                # current iteration concurrently.
                r = written().where(
                    (F.col(LEARNER) == learner) & (F.col(IT) <= it_done) & (F.col(STATE) == ACCEPTED)
                )
                cols = [ID, FEAT] if with_ids else [FEAT]
                return r.select(*cols, F.col(PS).alias(Y))

            def labeled(k: int, it_done: int, with_ids: bool = False):
                """L_k: the seed plus the rows the *other* learner accepted
                in iterations 1..it_done."""
                s = prep.seed_with_ids if with_ids else seed
                return s if it_done == 0 else s.unionByName(accepted_by(2 if k == 1 else 1, it_done, with_ids))

            ratio, max_chain = self.getOrDefault(self.compactRatio), self.getOrDefault(self.maxChain)
            pools = {
                k: ReplayPool(prep.pool, prep.n_pool, t, dedup, ratio, max_chain, VIEW,
                              view=lambda c, v=views[k]: slice_vector(c, v))
                for k in (1, 2)
            }

            def step(k: int, it: int) -> int:
                train = labeled(k, it - 1).withColumn(VIEW, slice_vector(FEAT, views[k]))
                model = fit_learner(learners[k], train, VIEW, Y, k_classes)
                fitted[k] = model
                return pools[k].step(
                    model, ws, f"ct/{LEARNER}={k}/{IT}={it}",
                    lambda rel: written().where((F.col(LEARNER) == k) & (F.col(IT) == it)),
                )

            fitted: dict = {}
            lab1 = lab2 = prep.n_seed
            history: list[dict] = []
            it, new = 1, 1
            past = run.iterations
            if past:
                history = [p["history"] for p in past]
                it, new = len(past) + 1, history[-1]["n_new1"] + history[-1]["n_new2"]
                lab1, lab2 = history[-1]["n_labeled1"], history[-1]["n_labeled2"]
                for k in (1, 2):
                    pools[k].restore(
                        [(f"{i}", p["history"][f"n_unlabeled{k}"], p["compacted"][k - 1], lambda i=i, k=k: run.model(i, f"model/{k}/{i}"))
                         for i, p in enumerate(past, 1)],
                        lambda i, k=k: written().where((F.col(LEARNER) == k) & (F.col(IT) == int(i))),
                    )
            while it <= self.getMaxIter() and pools[1].n_left > 0 and pools[2].n_left > 0 and new > 0:
                clock = Timer()
                a1, a2 = run_parallel([lambda: step(1, it), lambda: step(2, it)], par)
                new = a1 + a2
                lab1, lab2 = lab1 + a2, lab2 + a1
                n_agree = None
                if track:
                    n_agree = agreement(labeled(1, it, True), labeled(2, it, True), ID, FEAT, Y, mode).count()
                history.append(dict(iteration=it, n_new1=a1, n_new2=a2, n_labeled1=lab1, n_labeled2=lab2,
                                    n_unlabeled1=pools[1].n_left, n_unlabeled2=pools[2].n_left,
                                    n_agreement=n_agree, step_s=clock.lap()))
                run.complete(history[-1], {f"model/{k}/{it}": fitted[k] for k in (1, 2)},
                             compacted=[pools[1].compacted, pools[2].compacted])
                self.log_iteration(history[-1])
                it += 1
            done = it - 1
            agree = agreement(labeled(1, done, True), labeled(2, done, True), ID, FEAT, Y, mode)
            # Written once: the set involves shuffles, and learners make
            # several passes over their input before caching it.
            ws.write(agree.select(FEAT, Y), "agree")
            final = fit_learner(self.final, ws.read("agree"), num_classes=k_classes)
        model = make_model(self, final, prep, history, HISTORY_SCHEMA)
        model.views = (v1, v2)
        return model
