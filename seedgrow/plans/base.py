"""Shared pieces of the semi-supervised estimators.

Input contract: one DataFrame with ``featuresCol`` (vector), a numeric
``labelCol`` that is null for unlabelled rows, and optionally ``idCol``.
Each estimator is a ``pyspark.ml.Estimator`` (so it composes in a
``Pipeline`` and in ``CrossValidator``) and returns a
:class:`SemiSupervisedModel` wrapping an ordinary fitted base model.

Loop state lives in columns of a few parquet tables (see ``lineage``):
``__id, __f`` (dense features), ``__label`` (the caller's label, mapped to
the class index ``__y`` when read),
``__first`` (first copy of its vector in the pool) and per-iteration
``__ps`` (pseudo-label index) partitioned by ``state`` (accepted, still
in the pool, or a dropped duplicate) and ``it`` (iteration). A pool shrink is a directory filter, a labelled-set
growth is a union of directories — no set operation over vectors and no
shuffle besides the learner's own.
"""

from __future__ import annotations

import importlib
import json
import logging
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.classification import ProbabilisticClassifier
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from seedgrow.functions.labels import index_of_label, label_of_index
from seedgrow.functions.vectors import dense, max_probability, vector_size
from seedgrow.operators.dedup import mark_first_copies
from seedgrow.operators.indexing import DEFAULT_MAX_CLASSES, resolve_labels
from seedgrow.plans.lineage import Run, Workspace

ID, FEAT, Y, FIRST, POOL, PS, IT, STATE = "__id", "__f", "__y", "__first", "__pool", "__ps", "it", "state"
ACCEPTED, IN_POOL, GONE = "acc", "pool", "gone"
LABEL = "__label"
PRED, PROB, RAW, CONF = "__pred", "__prob", "__raw", "__conf"

MATCH_MODES = ("features", "id")
_log = logging.getLogger("seedgrow")


class SemiSupervisedMarker:
    """Capability marker: ``isinstance(est, SemiSupervisedMarker)`` tells a
    harness that the estimator consumes unlabelled rows."""


class _SharedParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    idCol = Param(
        Params._dummy(),
        "idCol",
        "unique row id column; generated and materialised once when absent",
        typeConverter=TypeConverters.toString,
    )

    maxClasses = Param(
        Params._dummy(),
        "maxClasses",
        "largest accepted label domain, a guard against an id-like or continuous label column; raise it for more classes",
        typeConverter=TypeConverters.toInt,
    )

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(idCol="row_id", maxClasses=DEFAULT_MAX_CLASSES)

    def setMaxClasses(self, value: int):
        return self._set(maxClasses=value)

    def getIdCol(self) -> str:
        return self.getOrDefault(self.idCol)

    def setIdCol(self, value: str):
        return self._set(idCol=value)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def setProbabilityCol(self, value: str):
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str):
        return self._set(rawPredictionCol=value)


class _LoopParams(_SharedParams, HasMaxIter):
    matchMode = Param(
        Params._dummy(),
        "matchMode",
        "'features': pool shrink and agreement by vector value with set semantics; 'id': by row id",
        typeConverter=TypeConverters.toString,
    )
    keepCheckpoints = Param(
        Params._dummy(), "keepCheckpoints", "keep the per-iteration tables after fit", typeConverter=TypeConverters.toBoolean
    )
    runName = Param(
        Params._dummy(), "runName",
        "names the fit's folder under the checkpoint folder; a fit that finds a manifest of that name there goes on from its "
        "last complete iteration, on the rows already written", typeConverter=TypeConverters.toString,
    )
    verbose = Param(Params._dummy(), "verbose", "log each iteration's counts", typeConverter=TypeConverters.toBoolean)
    compactRatio = Param(
        Params._dummy(), "compactRatio",
        "rewrite the remaining pool as a new base once it is smaller than this share of the current base",
        typeConverter=TypeConverters.toFloat,
    )
    maxChain = Param(Params._dummy(), "maxChain", "most models replayed over one base before compaction",
                     typeConverter=TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(maxIter=10, matchMode="features", keepCheckpoints=False,
                         verbose=False, compactRatio=0.5, maxChain=8)

    def setMaxIter(self, value: int):
        return self._set(maxIter=value)

    def setMatchMode(self, value: str):
        return self._set(matchMode=value)

    def setKeepCheckpoints(self, value: bool):
        return self._set(keepCheckpoints=value)

    def setRunName(self, value: str):
        return self._set(runName=value)

    def open_run(self, spark: SparkSession, kind: str) -> tuple[Workspace, Run]:
        """The fit's folder and its manifest. The state of a named run that
        fails stays; it goes when the run ends."""
        name = self.getOrDefault(self.runName) if self.isDefined(self.runName) else None
        ws = Workspace(spark, kind, self.getOrDefault(self.keepCheckpoints), name)
        skip = {"runName", "keepCheckpoints", "verbose", "maxIter"}
        settings = {p.name: self.getOrDefault(p) for p in self.params if p.name not in skip and self.isDefined(p)}
        return ws, Run(ws, json.loads(json.dumps(settings, sort_keys=True)), name is not None)

    def setVerbose(self, value: bool):
        return self._set(verbose=value)

    def setCompactRatio(self, value: float):
        return self._set(compactRatio=value)

    def setMaxChain(self, value: int):
        return self._set(maxChain=value)

    def log_iteration(self, row: dict) -> None:
        if self.getOrDefault(self.verbose):
            _log.info("%s %s", type(self).__name__, " ".join(f"{k}={v}" for k, v in row.items()))

    def getMatchMode(self) -> str:
        m = self.getOrDefault(self.matchMode)
        if m not in MATCH_MODES:
            raise ValueError(f"matchMode must be one of {MATCH_MODES}, got {m!r}")
        return m


def check_base(learner) -> None:
    if not isinstance(learner, ProbabilisticClassifier):
        raise TypeError(
            f"base learner must be a probabilistic classifier (random forest, naive Bayes, logistic regression, ...), "
            f"got {type(learner).__name__}"
        )


def with_class_count(df: DataFrame, label_col: str, num_classes: int) -> DataFrame:
    """Attach nominal-attribute metadata (``num_vals``) to the label, the
    way ``StringIndexer`` output carries it: learners then know the class
    count without a job over the data, and it cannot shrink when a training
    set happens to lack the highest class."""
    meta = {"ml_attr": {"type": "nominal", "num_vals": int(num_classes), "name": label_col}}
    return df.withColumn(label_col, F.col(label_col).alias(label_col, metadata=meta))


def fit_learner(learner, df: DataFrame, features_col: str = FEAT, label_col: str = Y, num_classes: int | None = None):
    if num_classes is not None:
        df = with_class_count(df, label_col, num_classes)
    return without_summary(learner.fit(df, {learner.featuresCol: features_col, learner.labelCol: label_col}))


def without_summary(model):
    """Drop a fitted model's training summary. It holds the session, which
    cannot be shipped to tasks once the session has observed a query, and a
    plan over the training rows, which are removed when the fit ends."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def outcome_metrics():
    return [
        F.sum((F.col(STATE) == ACCEPTED).cast("long")).alias("n_new"),
        F.sum((F.col(STATE) == IN_POOL).cast("long")).alias("n_left"),
    ]


def replay(pool: DataFrame, models: Sequence, threshold: float, dedup: bool, features_col: str = FEAT):
    """Apply the models of iterations 1..k, in order, to the original pool.

    Pool membership is a pure function of the row and the models so far: a
    row is still in the pool at iteration k if no earlier model accepted it
    (and, in ``features`` mode, it is the first copy of its vector once the
    first shrink has happened). Re-evaluating the earlier models costs k
    model evaluations per row, but spares rewriting the pool — vectors and
    all — to shared storage every iteration.

    Returns ``(df, in_pool, accept, prediction)`` as columns of ``df``:
    membership at iteration k, acceptance by model k, model k's prediction.
    """
    if not models:
        raise ValueError("replay needs at least one model")
    keep = F.col(FIRST) if dedup else F.lit(True)
    df, in_pool = pool, F.lit(True)
    last = len(models) - 1
    for j, m in enumerate(models):
        df = m.transform(
            df,
            {
                m.featuresCol: features_col,
                m.predictionCol: f"__pred{j}",
                m.probabilityCol: f"__prob{j}",
                m.rawPredictionCol: f"__raw{j}",
            },
        )
        confident = max_probability(f"__prob{j}") > F.lit(float(threshold))
        if j == last:
            return df, in_pool, in_pool & confident, F.col(f"__pred{j}")
        in_pool = in_pool & ~confident & keep


def tagged_rows(df: DataFrame, in_pool, accept, prediction, dedup: bool, keep_pool: bool):
    """Tag every pool row (``acc`` / ``pool`` / ``gone``), count the tags
    with an observation, and keep the accepted rows — plus, when compacting,
    the rows still in the pool — as ``(__id, __f, __first, __ps, state)``.

    The observation sits between the scoring projection and the filter;
    Catalyst does not push filters through it, so the models run once per
    row and the counts cover the whole pool."""
    from pyspark.sql import Observation

    keep = F.col(FIRST) if dedup else F.lit(True)
    state = F.when(accept, F.lit(ACCEPTED)).when(in_pool & keep, F.lit(IN_POOL)).otherwise(F.lit(GONE))
    tagged = df.select(ID, FEAT, FIRST, prediction.alias(PS), state.alias(STATE))
    obs = Observation()
    observed = tagged.observe(obs, *outcome_metrics())
    wanted = F.col(STATE) == ACCEPTED
    if keep_pool:
        wanted = wanted | (F.col(STATE) == IN_POOL)
    return observed.where(wanted), obs


class ReplayPool:
    """The pool of one learner: a base table plus the chain of models to
    replay over it.

    Each pass replays the chain and writes the newly accepted rows. When the
    pool has shrunk below ``ratio`` of the base, or the chain reaches
    ``max_chain`` models, the same pass also writes the rows still in the
    pool, which become the new base, and the chain restarts (compaction, as
    in log-structured storage). So a pass reads at most ``1/ratio`` times
    the live pool and evaluates at most ``max_chain`` models per row.
    """

    def __init__(self, base: DataFrame, n: int, threshold: float, dedup: bool, ratio: float, max_chain: int,
                 features_col: str = FEAT, view=None):
        self.base, self.base_n, self.n_left = base, n, n
        self.threshold, self.dedup = threshold, dedup
        self.ratio, self.max_chain = ratio, max_chain
        self.features_col, self.view = features_col, view
        self.chain: list = []
        self.compacted = False

    def restore(self, past: Sequence[tuple], reread) -> None:
        """Rebuild the state after the iterations ``past``: ``(folder, rows
        left, compacted, model)`` each."""
        for rel, left, compacted, model in past:
            self.chain.append(model())
            self.n_left = left
            if compacted:
                self.base, self.base_n, self.chain = reread(rel).where(F.col(STATE) == IN_POOL).select(ID, FEAT, FIRST), left, []

    def step(self, model, ws: Workspace, rel: str, reread) -> int:
        """Run one pass with ``model`` appended to the chain; write under
        ``rel`` (partitioned by ``state``); return the number accepted.
        ``reread(rel)`` must return the written table with ``state``."""
        self.chain.append(model)
        compact = self.n_left < self.ratio * self.base_n or len(self.chain) >= self.max_chain
        base = self.base if self.view is None else self.base.withColumn(self.features_col, self.view(F.col(FEAT)))
        df, in_pool, accept, pred = replay(base, self.chain, self.threshold, self.dedup, self.features_col)
        rows, obs = tagged_rows(df, in_pool, accept, pred, self.dedup, compact)
        if compact:
            ws.write(rows, rel, partition_by=[STATE])
        else:
            # Only accepted rows: write straight into their partition directory
            # (same layout, no dynamic-partition writer).
            ws.write(rows.drop(STATE), f"{rel}/{STATE}={ACCEPTED}")
        m = obs.get
        new, self.n_left = int(m.get("n_new") or 0), int(m.get("n_left") or 0)
        self.compacted = compact
        if compact:
            self.base = reread(rel).where(F.col(STATE) == IN_POOL).select(ID, FEAT, FIRST)
            self.base_n, self.chain = self.n_left, []
        return new


def run_parallel(fns: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Run independent Spark jobs from driver threads (as ``CrossValidator``
    does with ``parallelism``); results in input order."""
    if parallelism <= 1 or len(fns) <= 1:
        return [f() for f in fns]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(fns))) as ex:
        futures = [ex.submit(f) for f in fns]
        return [f.result() for f in futures]


class Prepared:
    """Result of :func:`prepare`: the base table, the label domain and the
    observed counts."""

    def __init__(self, table: DataFrame, labels: list, identity: bool, stats: dict, tables: Sequence[DataFrame] = ()):
        self.table = table
        self.tables = list(tables)
        self.stats = dict(stats)
        self.labels = labels
        self.identity = identity
        self.n_seed = int(stats.get("n_seed") or 0)
        self.n_pool = int(stats.get("n_pool") or 0)
        self.n_pool_distinct = int(stats.get("n_pool_first") or 0)
        self.min_dim = stats.get("min_dim")
        self.max_dim = stats.get("max_dim")

    @property
    def num_classes(self) -> int:
        return len(self.labels)

    def _y(self):
        lab = F.col(LABEL)
        return (lab if self.identity else index_of_label(lab, self.labels)).alias(Y)

    @property
    def seed(self) -> DataFrame:
        return self.table.where(~F.col(POOL)).select(FEAT, self._y())

    @property
    def seed_with_ids(self) -> DataFrame:
        return self.table.where(~F.col(POOL)).select(ID, FEAT, self._y())

    @property
    def pool(self) -> DataFrame:
        return self.table.where(F.col(POOL)).select(ID, FEAT, FIRST)


def write_samples(est: _SharedParams, dataset: DataFrame, ws: Workspace,
                  partition_by: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The sample table of one fit: ``(__id, __f, __label, __pool)`` of every
    row of ``dataset``, written in one pass, and what that pass observed.

    Whatever derives the features (text functions, joins) is evaluated here
    and nowhere else; a learner makes several passes, and all of them read
    the written rows. ``__id`` is null where the input has no id column.
    """
    fcol, lcol, icol = est.getFeaturesCol(), est.getLabelCol(), est.getIdCol()
    for c in (fcol, lcol):
        if c not in dataset.columns:
            raise ValueError(f"input has no column {c!r}")
    if not isinstance(dataset.schema[lcol].dataType, NumericType):
        raise TypeError(f"label column {lcol!r} must be numeric; index string labels with StringIndexer first")
    state = dataset.select(
        (F.col(icol) if icol in dataset.columns else F.lit(None).cast("long")).alias(ID),
        dense(fcol).alias(FEAT),
        F.col(lcol).cast("double").alias(LABEL),
        F.col(lcol).isNull().alias(POOL),
    )
    dim = vector_size(FEAT)
    pool_flag = F.col(POOL).cast("long")
    stats = ws.write(
        state,
        "input",
        partition_by=partition_by,
        metrics=[
            F.sum(F.lit(1) - pool_flag).alias("n_seed"),
            F.sum(pool_flag).alias("n_pool"),
            F.sum(F.col(ID).isNull().cast("long")).alias("n_null_ids"),
            F.min(dim).alias("min_dim"),
            F.max(dim).alias("max_dim"),
        ],
    )
    if stats.get("min_dim") is not None and stats["min_dim"] != stats["max_dim"]:
        raise ValueError(f"feature vectors have different sizes ({stats['min_dim']}..{stats['max_dim']})")
    return ws.read("input", state.schema), stats


def prepare_run(est: _LoopParams, dataset: DataFrame, ws: Workspace, run: Run, dedup: bool) -> Prepared:
    """``prepare``, or what a named run prepared before it was interrupted."""
    old = run.prepared
    if old is None:
        prep = prepare(est, dataset, ws, dedup)
        run.set_prepared({"labels": prep.labels, "identity": prep.identity, "stats": prep.stats,
                          "schemas": [t.schema.json() for t in prep.tables]})
        return prep
    schemas = [StructType.fromJson(json.loads(x)) for x in old["schemas"]]
    return Prepared(_base_table([ws.read(rel, x) for rel, x in zip(("input", "pool"), schemas)]), old["labels"], old["identity"], old["stats"])


def _base_table(tables: list[DataFrame]) -> DataFrame:
    """The loop's rows: the written input, or its seed and the written pool
    with first-copy flags."""
    if len(tables) == 1:
        return tables[0].withColumn(FIRST, F.lit(True))
    seed = tables[0].where(~F.col(POOL)).withColumn(FIRST, F.lit(True))
    return seed.unionByName(tables[1])


def prepare(est: _LoopParams, dataset: DataFrame, ws: Workspace, dedup: bool) -> Prepared:
    """Normalise the input once and write it as the loop's base table.

    One pass over the caller's input writes ``(__id, __f, __label)``
    partitioned by ``__pool`` and observes the counts and the vector
    dimension range. Everything else reads those files: the check that ids
    are unique, the first-copy flags (written once more for the pool, in
    ``features`` mode) and the label domain. So the caller's pipeline is
    evaluated exactly once, and generated ids are the same in every branch.
    """
    icol = est.getIdCol()
    df = dataset
    if icol not in df.columns:
        # Not repeatable, so nothing but the write below may see it.
        df = df.withColumn(icol, F.monotonically_increasing_id())
    table, stats = write_samples(est, df, ws, partition_by=[POOL])
    if stats.get("n_null_ids"):
        raise ValueError(f"{icol!r} is null in {stats['n_null_ids']} rows")
    if icol in dataset.columns:
        # Exact; ids alone are read and shuffled.
        repeated = table.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).collect()
        if repeated:
            raise ValueError(f"{icol!r} is not a unique row id: {repeated[0][ID]!r} occurs {repeated[0]['n']} times")
    stats = dict(stats, n_pool_first=stats.get("n_pool"))
    if dedup:
        # From the written rows, so every branch sees the same ids.
        pool = mark_first_copies(table.where(F.col(POOL)), ID, FEAT, FIRST)
        first = ws.write(pool, "pool", partition_by=[POOL], metrics=[F.sum(F.col(FIRST).cast("long")).alias("n_pool_first")])
        stats.update(first)
        tables = [table, ws.read("pool", pool.schema)]
    else:
        tables = [table]
    table = _base_table(tables)
    labels, identity = resolve_labels(table.where(~F.col(POOL)), LABEL, est.getOrDefault(est.maxClasses))
    if len(labels) < 2:
        raise ValueError(f"the labelled rows must cover at least two classes, found {labels}")
    return Prepared(table, labels, identity, stats, tables)


class SemiSupervisedModel(Model, _SharedParams, MLWritable, MLReadable):
    """A fitted base model plus the label list and the loop history.

    ``transform`` appends the base model's ``rawPrediction`` and
    ``probability`` (class positions follow ``labels``) and ``prediction``
    in the caller's label values. Saved and loaded with ``save``/``load``,
    also as a stage of a saved ``PipelineModel``.
    """

    def __init__(self, base_model=None, labels: Sequence | None = None, identity: bool = True,
                 history_rows: list[dict] | None = None, history_schema: str | None = None):
        super().__init__()
        self.baseModel = base_model
        self.labels = list(labels or [])
        self.identity = identity
        self._history_rows = list(history_rows or [])
        self._history_schema = history_schema

    @property
    def history(self) -> DataFrame:
        """One row per loop iteration (loop-control numbers only)."""
        # The active session is thread-local; fall back to the process's one.
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return spark.createDataFrame(self._history_rows, self._history_schema)

    @property
    def history_rows(self) -> list[dict]:
        return list(self._history_rows)

    @property
    def numClasses(self) -> int:
        return len(self.labels)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m = self.baseModel
        pcol = self.getPredictionCol()
        tmp = pcol if self.identity else "__pred_index"
        out = m.transform(
            dataset,
            {
                m.featuresCol: self.getFeaturesCol(),
                m.predictionCol: tmp,
                m.probabilityCol: self.getProbabilityCol(),
                m.rawPredictionCol: self.getRawPredictionCol(),
            },
        )
        if not self.identity:
            out = out.withColumn(pcol, label_of_index(tmp, self.labels).cast("double")).drop(tmp)
        return out

    def copy(self, extra=None):
        that = super().copy(extra)
        that.baseModel = self.baseModel.copy() if self.baseModel is not None else None
        return that

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: SemiSupervisedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        inst = self.instance
        base = inst.baseModel
        extra = {
            "labels": inst.labels,
            "identity": inst.identity,
            "historyRows": inst._history_rows,
            "historySchema": inst._history_schema,
            "baseClass": f"{type(base).__module__}.{type(base).__name__}",
        }
        DefaultParamsWriter.saveMetadata(inst, path, self.sparkSession, extraMetadata=extra)
        base.write().overwrite().save(f"{path.rstrip('/')}/base")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SemiSupervisedModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        module, name = meta["baseClass"].rsplit(".", 1)
        base = getattr(importlib.import_module(module), name).load(f"{path.rstrip('/')}/base")
        m = self.cls(base, meta["labels"], meta["identity"], meta["historyRows"], meta["historySchema"])
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        return m


def make_model(est, base_model, prepared: Prepared, history: list[dict], schema: str) -> SemiSupervisedModel:
    m = SemiSupervisedModel(base_model, prepared.labels, prepared.identity, history, schema)
    est._copyValues(m)
    return m


class Timer:
    def __init__(self) -> None:
        self.t = time.perf_counter()

    def lap(self) -> float:
        now = time.perf_counter()
        d, self.t = now - self.t, now
        return round(d, 3)
