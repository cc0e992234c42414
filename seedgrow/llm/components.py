"""Connected components of a link table by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest one (large
star), then its smaller neighbours (small star); the rounds end when the links
are a forest of stars, after O(log^2 n) rounds at worst. State is written
between rounds. A hub's links are spread: its minimum is a partial aggregate,
and the join back on the hub is a plain equi-join, which the adaptive planner
splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links ``a > b`` (no loops)."""
    if large:
        sides = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        e = links.select(F.explode(sides).alias("x")).select("x.u", "x.v")
    else:
        e = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = e.join(least, "u")
    if large:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
        out = j.select(F.explode(pairs).alias("x")).select("x.a", "x.b")
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node with a link; root is the smallest node
    of its component. ``links`` has columns ``a`` and ``b``, in any order,
    repeated or not."""
    e = links.where(F.col("a") != F.col("b"))
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, "links")
    seen = None
    while True:
        e = scratch.keep(_star(_star(e, True), False), "stars")
        digest = e.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if digest["n"] == 0 or digest == seen:
            break
        seen = digest
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
