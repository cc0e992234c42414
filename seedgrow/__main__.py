"""Command line: ``python -m seedgrow sweep INPUT OUTPUT [--fractions ...]``."""

from __future__ import annotations

import argparse

from seedgrow.plans.sweep import run_sweep
from seedgrow.session import local_session


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="seedgrow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sw = sub.add_parser("sweep", help="labelled-fraction sweep over four algorithms")
    sw.add_argument("input", help="text file(s): label,f1 f2 ...")
    sw.add_argument("output", help="result table directory (parquet, partitioned by name)")
    sw.add_argument("--fractions", type=float, nargs="*", default=None)
    sw.add_argument("--folds", type=int, nargs="*", default=[42])
    sw.add_argument("--master-cpus", default="*", help="local session only, when run outside spark-submit")
    args = ap.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or local_session(args.master_cpus)
    out = run_sweep(spark, args.input, args.output, args.fractions, args.folds)
    out.orderBy("name", "label_fraction").show(100, truncate=False)


if __name__ == "__main__":
    main()
