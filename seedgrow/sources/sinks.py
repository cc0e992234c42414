"""Sinks: the ROC curve and the result tables.

The original wrote each table through a single task into a text file
(``repartition(1)``). Here every sink is an ordinary distributed DataFrame
write: one write for all algorithms (partitioned by ``name``); overwriting is
a staged commit instead of disabled output validation.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write ``df`` to ``path``. An overwrite is staged: the rows are written
    beside the target, and only a complete write takes its place, by two
    renames. So a failed write leaves the old table as it was, and ``df`` may read
    the table that it replaces. A crash between the renames leaves the old table
    under ``<path>.__old``, from where the next overwrite restores it first."""
    if mode != "overwrite":
        _write(df, path, fmt, partition_by, mode)
        return
    path = path.rstrip("/")
    sc = df.sparkSession.sparkContext
    at = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(sc._jsc.hadoopConfiguration())
    stage, old = f"{path}.__new-{uuid.uuid4().hex[:12]}", f"{path}.__old"
    if fs.exists(at(old)) and not fs.exists(at(path)):
        fs.rename(at(old), at(path))
    try:
        _write(df, stage, fmt, partition_by, "error")
    except BaseException:
        fs.delete(at(stage), True)
        raise
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        fs.delete(at(stage), True)
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(at(stage), at(path)):
        if fs.exists(at(old)):
            fs.rename(at(old), at(path))
        fs.delete(at(stage), True)
        raise OSError(f"cannot put the new table at {path}")
    fs.delete(at(old), True)


def _write(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] | None, mode: str) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_roc(roc: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S4: ROC points ``(threshold, fpr, tpr)``."""
    write_table(roc, path, fmt)


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S5: evaluation rows, one directory per algorithm name."""
    write_table(results, path, fmt, partition_by=["name"])
