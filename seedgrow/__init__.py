"""seedgrow: semi-supervised classification on Spark DataFrames.

Self-Training, hard EM and Co-Training as ``pyspark.ml`` estimators around
any probabilistic Spark classifier, the pseudo-labelling operators they are
built from, and an evaluation layer whose every table stays distributed.
"""

from seedgrow.plans import CoTraining, HardEM, SelfTraining, SemiSupervisedModel
from seedgrow.plans.supervised import Supervised

__all__ = ["CoTraining", "HardEM", "SelfTraining", "SemiSupervisedModel", "Supervised"]
