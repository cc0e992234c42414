"""Iterative plans: the three semi-supervised estimators and the
evaluation harness."""

from seedgrow.plans.base import SemiSupervisedMarker, SemiSupervisedModel
from seedgrow.plans.cotraining import CoTraining, default_views
from seedgrow.plans.em import HardEM
from seedgrow.plans.lineage import Workspace, checkpoint_root
from seedgrow.plans.evaluate import evaluate_all, roc_for
from seedgrow.plans.selftraining import SelfTraining
from seedgrow.plans.supervised import Supervised
from seedgrow.plans.sweep import run_sweep

__all__ = [
    "SemiSupervisedMarker",
    "SemiSupervisedModel",
    "CoTraining",
    "default_views",
    "HardEM",
    "SelfTraining",
    "Supervised",
    "evaluate_all",
    "roc_for",
    "run_sweep",
    "Workspace",
    "checkpoint_root",
]
