"""Session helpers for entry points, tests, the bench and local runs.

Library code never creates a session and never picks a folder: it uses the
caller's session and raises when ``spark.checkpoint.dir`` is unset
(``plans.lineage.checkpoint_root``).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The session's checkpoint folder. Where none is named, an entry point
    or a test on one machine gets ``fallback`` or a scratch folder that is
    deleted when the process ends; a cluster must name one."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set on a cluster session")
        d = fallback
        if d is None:
            d = tempfile.mkdtemp(prefix="seedgrow-ckpt-")
            atexit.register(shutil.rmtree, d, ignore_errors=True)
        os.makedirs(d, exist_ok=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "seedgrow",
                  checkpoint_dir: str | None = None, driver_memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark
