"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedgrow.plans.lineage import checkpoint_root, keep_until_released

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# Fixed value: Spark's setting to delete a query's shuffle files when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries that end inside leave no shuffle files behind (where this
    Spark has the setting): what they wrote is read from then on."""
    try:
        before = spark.conf.get(_RELEASE)
    except PySparkException:
        yield
        return
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


class Scratch:
    """Tables written under the session's checkpoint folder and read back.

    A written table cuts the lineage on storage that all executors share, and
    gives the planner its true size, so that it broadcasts a side only when
    that side is known to be below ``autoBroadcastJoinThreshold``. The files
    stay until they are released (``plans.lineage.release``): a returned DataFrame
    may still read them.
    """

    def __init__(self, spark: SparkSession, kind: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/seedgrow-{kind}-{uuid.uuid4().hex[:12]}"
        keep_until_released(self.root)
        self._n = 0
        self._at: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        w = df.write
        if partition_by is not None:
            w = w.partitionBy(partition_by)
        with shuffles_released(self.spark):
            w.parquet(path)
        self._at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, part: str = "") -> None:
        """Delete a table (the last one kept under ``name``), or the part of it
        in one partition folder, that nothing reads any more."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self._at[name] + (f"/{part}" if part else ""))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
