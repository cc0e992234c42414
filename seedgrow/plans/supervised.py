"""Supervised baseline with the same label handling as the loops.

Fits the base learner on the labelled rows only (null labels are ignored),
after indexing labels that are not already ``0 .. k-1`` (e.g. ``-1/+1``).
The labelled rows are written once (``write_samples``) and every pass of the
learner reads the files, so derived features are computed once. Returns the
same :class:`SemiSupervisedModel` as the loops, so a harness treats every
algorithm alike.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import functions as F

from seedgrow.functions.labels import index_of_label
from seedgrow.operators.indexing import resolve_labels
from seedgrow.plans.base import FEAT, LABEL, Y, SemiSupervisedModel, _SharedParams, check_base, fit_learner, write_samples
from seedgrow.plans.lineage import Workspace

HISTORY_SCHEMA = "iteration int"


class Supervised(Estimator, _SharedParams):
    def __init__(self, base, featuresCol: str = "features", labelCol: str = "label",
                 maxClasses: int | None = None):
        super().__init__()
        check_base(base)
        self.base = base
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        if maxClasses is not None:
            self._set(maxClasses=maxClasses)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.base = self.base.copy()
        return that

    def _fit(self, dataset):
        lcol = self.getLabelCol()
        if lcol not in dataset.columns:
            raise ValueError(f"input has no column {lcol!r}")
        with Workspace(dataset.sparkSession, "supervised") as ws:
            lab, _ = write_samples(self, dataset.where(F.col(lcol).isNotNull()), ws)
            labels, identity = resolve_labels(lab, LABEL, self.getOrDefault(self.maxClasses))
            if len(labels) < 2:
                raise ValueError(f"the labelled rows must cover at least two classes, found {labels}")
            y = F.col(LABEL) if identity else index_of_label(LABEL, labels)
            model = fit_learner(self.base, lab.select(FEAT, y.alias(Y)), num_classes=len(labels))
        m = SemiSupervisedModel(model, labels, identity, [], HISTORY_SCHEMA)
        self._copyValues(m)
        return m
