"""Loop state on shared storage.

Each loop iteration writes its state once, as parquet, under the folder the
cluster names in ``spark.checkpoint.dir``, and the next iteration reads it
back. That

* cuts the lineage: the plan of iteration k does not contain iterations
  1..k-1, so planning time and recomputation after a lost executor stay
  constant;
* survives executor loss (the files are on the shared file system, not in
  executor memory or on executor-local disks);
* lets the next iteration prune columns and partitions (counts read no
  vectors; the pool read skips accepted rows by directory).

Loop-control numbers come back from the same write through an
``Observation`` — no second pass over the data.

**Life cycle.** A fit's folder goes when the fit ends. State that a returned
DataFrame still reads is kept and listed; ``release`` removes it once the result
has been read, and ``releasing`` does so for everything kept inside its block.
A loop with a named run writes a manifest after each complete iteration; a fit
of that name that finds one goes on from there (``Run``).
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; raises when none is configured."""
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError(
            "no checkpoint folder: set spark.checkpoint.dir (or SparkContext.setCheckpointDir) "
            "to a folder on storage shared by all executors"
        )
    return d


# Folders that results may still read, by folder, in the order they were made.
_kept: dict[str, None] = {}


def keep_until_released(root: str) -> None:
    """List a folder that a returned DataFrame may read."""
    _kept[root] = None


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, but: set[str] = frozenset()) -> int:
    """Remove all kept state (except the folders ``but``): call it once the
    DataFrames that were returned so far have been read. Returns their number."""
    gone = [r for r in _kept if r not in but]
    for r in gone:
        _remove(spark, r)
        _kept.pop(r, None)
    return len(gone)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Remove the state kept inside the block when it ends."""
    before = set(_kept)
    try:
        yield
    finally:
        release(spark, before)


class Workspace:
    """A private folder for one ``fit`` call, removed when the fit ends, or
    with ``keep`` when it is released. A named one is found again by its name."""

    def __init__(self, spark: SparkSession, kind: str, keep: bool = False, name: str | None = None):
        self.spark = spark
        self.keep = keep
        self.root = f"{checkpoint_root(spark).rstrip('/')}/seedgrow-{kind}-{name or uuid.uuid4().hex[:12]}"
        if keep:
            keep_until_released(self.root)

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def write(
        self,
        df: DataFrame,
        rel: str,
        partition_by: list[str] | None = None,
        metrics: list[Column] | None = None,
    ) -> dict:
        """Write ``df`` to ``rel`` (overwrite, so a retried step is
        idempotent) and return the observed ``metrics``."""
        obs = Observation() if metrics else None
        if obs is not None:
            df = df.observe(obs, *metrics)
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(self.path(rel))
        return dict(obs.get) if obs is not None else {}

    def read(self, rel: str, schema: StructType | None = None) -> DataFrame:
        r = self.spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(self.path(rel))

    def delete(self, rel: str | None = None) -> None:
        _remove(self.spark, self.path(rel) if rel else self.root)

    def write_json(self, rel: str, value) -> None:
        """Write a small value; complete or absent (written aside, renamed)."""
        fs, path = self._fs(f"{rel}.new")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        target = self._fs(rel)[1]
        fs.delete(target, False)
        fs.rename(path, target)

    def read_json(self, rel: str):
        """The value written last, or None."""
        fs, path = self._fs(rel)
        if not fs.exists(path):
            path = self._fs(f"{rel}.new")[1]  # complete once the old one is gone
            if not fs.exists(path):
                return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(path.toString()).collect()))

    def _fs(self, rel: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path(rel))
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def save_model(self, model, rel: str) -> str:
        model.write().overwrite().save(self.path(rel))
        return f"{type(model).__module__}.{type(model).__name__}"

    def load_model(self, kind: str, rel: str):
        module, name = kind.rsplit(".", 1)
        return getattr(importlib.import_module(module), name).load(self.path(rel))

    def close(self) -> None:
        if not self.keep:
            self.delete()

    @contextmanager
    def ending(self, named: bool) -> Iterator[None]:
        """Remove the folder when the block ends; a named run's only when it
        ends well, so that it can go on."""
        try:
            yield
        except BaseException:
            if not named:
                self.close()
            raise
        self.close()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


class Run:
    """The manifest of a named loop: settings, what ``prepare`` found, and one
    entry per complete iteration. Without a name nothing is written."""

    def __init__(self, ws: Workspace, settings: dict, named: bool):
        self.ws, self.named = ws, named
        found = ws.read_json("manifest.json") if named else None
        if found is not None and found["settings"] != settings:
            raise ValueError(f"{ws.root} holds a run with other settings: {found['settings']}")
        self.state = found or {"settings": settings, "prepared": None, "iterations": []}

    @property
    def prepared(self) -> dict | None:
        return self.state["prepared"]

    @property
    def iterations(self) -> list[dict]:
        return self.state["iterations"]

    def set_prepared(self, value: dict) -> None:
        self.state["prepared"] = value
        self._write()

    def complete(self, history: dict, models: dict, **more) -> None:
        """One iteration is complete: its history row, its models by folder."""
        if not self.named:
            return
        kinds = {rel: self.ws.save_model(m, rel) for rel, m in models.items()}
        self.iterations.append({"history": history, "models": kinds, **more})
        self._write()

    def model(self, iteration: int, rel: str):
        return self.ws.load_model(self.iterations[iteration - 1]["models"][rel], rel)

    def _write(self) -> None:
        if self.named:
            self.ws.write_json("manifest.json", self.state)
