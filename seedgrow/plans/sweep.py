"""The original tool's end-to-end run: labelled-fraction sweep over four
algorithms on a ``label,f1 f2 ...`` text file, one result table per
algorithm.

Defaults are the original's settings: random forest of 15 trees
everywhere; hard EM with tol 3 % and 7 iterations; Self-Training with
threshold .95 and 3 iterations; Co-Training with threshold .90 and 3
iterations; fractions .120 .125 .130 .135 .145 ... .195; one fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedgrow.operators.splits import sweep_fractions
from seedgrow.plans.cotraining import CoTraining
from seedgrow.plans.em import HardEM
from seedgrow.plans.evaluate import evaluate_all
from seedgrow.plans.lineage import Workspace
from seedgrow.plans.selftraining import SelfTraining
from seedgrow.plans.supervised import Supervised
from seedgrow.sources.sinks import write_results
from seedgrow.sources.text import read_labeled_text


def default_algorithms(num_trees: int = 15, seed: int = 7):
    def rf(k: int) -> RandomForestClassifier:
        return RandomForestClassifier(numTrees=num_trees, seed=seed + k)

    return [
        (Supervised(rf(0)), "RandomForest"),
        (HardEM(rf(1), tolPercent=3.0, maxIter=7), "EM"),
        (SelfTraining(rf(2), threshold=0.95, maxIter=3), "SelfTraining"),
        (CoTraining(rf(3), rf(4), rf(5), threshold=0.90, maxIter=3), "CoTraining"),
    ]


def run_sweep(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    fractions: Sequence[float] | None = None,
    fold_seeds: Sequence[int] = (42,),
    positive: float = 1.0,
    algorithms=None,
    parallelism: int = 1,
) -> DataFrame:
    """Parse the text file (strict: a bad line fails the job, as the
    original), give every line a stable id, evaluate and write the results
    (``partitionBy(name)``). Returns the written table."""
    fractions = list(fractions) if fractions is not None else sweep_fractions()
    algorithms = algorithms or default_algorithms()
    ws = Workspace(spark, "sweep")
    try:
        parsed = read_labeled_text(spark, input_path, mode="strict")
        # Ids from the physical layout are stable only once written.
        ws.write(parsed.withColumn("row_id", F.monotonically_increasing_id()), "input")
        data = ws.read("input")
        res = evaluate_all(algorithms, data, fractions, list(fold_seeds), positive, with_timing=True,
                           parallelism=parallelism)
        write_results(res, output_path)
    finally:
        ws.close()
    return spark.read.parquet(output_path)
