"""Print the formatted physical plans of representative operators.

Usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from seedgrow import workloads as W  # noqa: E402
from seedgrow.operators import dedup, metrics, pseudo, setops  # noqa: E402
from seedgrow.plans.base import FEAT, FIRST, ID, replay, tagged_rows  # noqa: E402
from seedgrow.session import local_session  # noqa: E402
from seedgrow.sources import tables  # noqa: E402


def show(title, df):
    print(f"\n===== {title}")
    df.explain("formatted")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    seed, pool = W.seed_and_pool(spark, sf)
    show("hide_labels: column pruning + hash-split filter at the scan", pseudo.hide_labels(pool).select("row_id", "label"))
    model = W.nb().fit(seed)
    show("reliable_pseudo_labels: score once, observation barrier, then filter", pseudo.reliable_pseudo_labels(model, pool, 0.95, list(range(10))))
    _, dpool = W.duplicated_pool(spark, sf)
    show("first-copy flag: partial aggregate by vector, join on unique id", dedup.mark_first_copies(dpool))
    acc = pseudo.reliable_pseudo_labels(model, dpool, 0.95, list(range(10)))
    show("pool_except: distinct both sides (partial agg) then anti join", setops.pool_except(dpool, acc))
    show("weighted metrics: no join, one explode + groupBy", metrics.weighted_metrics(W.quality_scored(spark, sf)))
    show("auc: groupBy(score), bucketed prefix sums, bounded broadcast", metrics.auc(W.quality_scored(spark, sf), "label", "score"))
    dup_seed, _ = W.duplicated_pool(spark, sf)
    m2 = W.nb().fit(dup_seed)
    p = dpool.select(F.col("row_id").alias(ID), F.col("features").alias(FEAT), F.lit(True).alias(FIRST))
    df, in_pool, accept, pred = replay(p, [model, m2], 0.95, True)
    rows, _ = tagged_rows(df, in_pool, accept, pred, True, keep_pool=False)
    show("loop pass: two models replayed, observation barrier, only accepted rows kept", rows)
    show("quality fixture: scan, join labels (AQE may broadcast)", tables.quality_samples(spark, sf))


if __name__ == "__main__":
    main()
