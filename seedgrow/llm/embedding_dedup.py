"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``M`` random directions. Two vectors collide in
a projection when their values lie within a window of half-width ``WIDTH``
centred on the query. A pair that collides in at least ``NEED`` projections is
a candidate, and its cosine is verified in double precision. For a pair at
the threshold (distance sqrt(2 - 2 * 0.95) = 0.316) one projection collides
with probability 2 * Phi(WIDTH / 0.316) - 1; ``NEED`` is the largest count that
such a pair reaches with probability RECALL (``calibrate``), so every pair at
or above the threshold is found at least that often.

Comparing all windows of all vectors is quadratic, so vectors are first dealt
into regions: in each of ``TABLES`` tables a region is a cell of ``AXES``
further projections, cut into cells of width ``CELL`` with a random offset. A
pair is counted in the first table in which it shares a region, which needs no
removal of repeats. ``tables_recall`` gives the probability that a pair at the
threshold shares a region in some table; closer pairs share one more often.

Equal vectors are one class and are joined once. Inside a region the
projections are sorted, each query's windows are cut out by binary search, and
collisions are added up. A region above ``REGION`` vectors is joined in
pairs of blocks, exactly. A task holds at most two blocks.

Edge cases: a null or zero vector, or one with a null or non-finite component,
links with nothing (n_links 0, its own component, kept); vectors of different
lengths never link (each length has its own regions); repeated rows with
different ids link with each other; a null vec_id is kept with component null
unless its component holds an id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.llm.common import Scratch, read_table
from seedgrow.llm.components import components

# The threshold, the counted projections and their windows.
THRESHOLD = 0.95
DISTANCE = math.sqrt(2 - 2 * THRESHOLD)
M = 24
WIDTH = 0.62
RECALL = 0.99
# The regions.
TABLES = 12
AXES = 5
CELL = 1.3
REGION = 2000
SEED = 7


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def calibrate(recall: float = RECALL) -> int:
    """The largest number of collisions that a pair at the threshold reaches
    with probability ``recall``."""
    p = 2 * _phi(WIDTH / DISTANCE) - 1
    tail = 0.0
    for k in range(M, -1, -1):
        tail += math.comb(M, k) * p**k * (1 - p) ** (M - k)
        if tail >= recall:
            return k
    return 0


def tables_recall(distance: float = DISTANCE) -> float:
    """Probability that a pair at this distance shares a region in a table."""
    c = CELL / distance
    cell = 1 - 2 * _phi(-c) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))
    return 1 - (1 - cell**AXES) ** TABLES


@lru_cache(maxsize=8)
def directions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counted directions, axis directions and the offsets of the cells."""
    rng = np.random.default_rng([SEED, dim])
    counted = rng.standard_normal((dim, M))
    axes = rng.standard_normal((dim, TABLES * AXES))
    return counted, axes, rng.random(TABLES * AXES) * CELL


def cells(unit: np.ndarray) -> np.ndarray:
    """Region key of each vector in each table (rows x TABLES)."""
    _, axes, offsets = directions(unit.shape[1])
    c = np.floor((unit @ axes + offsets) / CELL).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, AXES)
    key = np.full((len(unit), TABLES), unit.shape[1], np.uint64)
    for a in range(AXES):
        key = (key ^ c[:, :, a]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _prepare(batches: Iterator) -> Iterator:
    """``vec_id, sig, unit``: the unit vector, and a hash of equal vectors."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        sigs, units = [], []
        for v in b.column("embedding").to_pylist():
            u = None
            if v and not any(x is None for x in v):
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x = x / top
                    u = x / np.sqrt((x * x).sum())
                    u = u + 0.0  # no negative zeros
            units.append(u)
            h = None if u is None else xxhash.xxh3_64_intdigest(u.tobytes())
            sigs.append(h if h is None or h < 1 << 63 else h - (1 << 64))
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id"), pa.array(sigs, pa.int64()), pa.array(units, pa.list_(pa.float64()))],
            ["vec_id", "sig", "unit"],
        )


def _regions(batches: Iterator) -> Iterator:
    """One row per class and table: ``t, cell, sig, copies, unit``."""
    import pyarrow as pa

    for b in batches:
        units = b.column("unit").to_pylist()
        for dim in sorted({len(u) for u in units}):
            at = [i for i, u in enumerate(units) if len(u) == dim]
            x = np.array([units[i] for i in at])
            keys = cells(x)
            part = b.take(pa.array(at))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int32)), pa.array(keys[:, t]), part.column("sig"),
                     part.column("copies"), part.column("unit")],
                    ["t", "cell", "sig", "copies", "unit"],
                )


def _candidates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) that collide in ``calibrate()`` windows."""
    need = calibrate()
    counted = directions(left.shape[1])[0]
    p, q = left @ counted, right @ counted
    hits = np.zeros((len(left), len(right)), np.uint8)
    rows = np.arange(len(left))
    for m in range(M):
        order = np.argsort(q[:, m], kind="stable")
        line = q[order, m]
        lo = np.searchsorted(line, p[:, m] - WIDTH, "left")
        hi = np.searchsorted(line, p[:, m] + WIDTH, "right")
        n = hi - lo
        i = np.repeat(rows, n)
        j = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        hits[i, j] += 1  # within one projection a pair occurs once
    return np.nonzero(hits >= need)


def _join_block(rows):
    """Links of one block pair of a region, as counts and a spanning forest.

    A pandas frame with ``t, sig, copies, unit, side``: side 0 meets side 1;
    where all rows are side 2 they meet each other.
    """
    import pandas as pd

    rows = rows.sort_values("sig").reset_index(drop=True)
    t = int(rows["t"].iloc[0])
    unit = np.stack(rows["unit"].to_numpy())
    sig, copies = rows["sig"].to_numpy(), rows["copies"].to_numpy(np.int64)
    side = rows["side"].to_numpy()
    left = np.flatnonzero(side != 1)
    right = np.flatnonzero(side != 0)
    early = cells(unit)[:, :t]
    links = np.zeros(len(rows), np.int64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a_out, b_out = [], []
    for k in range(0, len(left), STRIP):
        strip = left[k : k + STRIP]
        i, j = _candidates(unit[strip], unit[right])
        i, j = strip[i], right[j]
        once = i < j if side[0] == 2 else np.ones(len(i), bool)
        i, j = i[once], j[once]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= THRESHOLD
        i, j = i[ok], j[ok]
        if t:
            new = ~(early[i] == early[j]).any(axis=1)
            i, j = i[new], j[new]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(x), find(y)
            if p != q:
                parent[p] = q
                a_out.append(sig[x])
                b_out.append(sig[y])
    at = np.flatnonzero(links)
    return pd.DataFrame(
        {
            "a": np.concatenate([sig[at], np.array(a_out, np.int64)]),
            "b": np.concatenate([np.zeros(len(at), np.int64), np.array(b_out, np.int64)]),
            "links": np.concatenate([links[at], np.full(len(a_out), -1, np.int64)]),
        }
    )


# Queries handled at once inside a block: bounds the table of counts.
STRIP = 256


def link_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.keep(v.mapInArrow(_prepare, "vec_id bigint, sig bigint, unit array<double>"), "units")
    good = rows.where(F.col("sig").isNotNull())
    classes = scratch.keep(
        good.groupBy("sig").agg(
            F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("unit").alias("unit")
        ), "classes"
    )
    members = classes.select("sig", "copies", "unit").mapInArrow(
        _regions, "t int, cell bigint, sig bigint, copies bigint, unit array<double>"
    )
    members = scratch.keep(members, "regions")
    size = members.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(REGION)).cast("int")
    m = members.join(size.select("t", "cell", blocks.alias("blocks")), ["t", "cell"])
    # One block: its rows meet each other. More: each pair of blocks is a group.
    m = m.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), F.lit(2)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1))
    m = m.select(
        "t", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        "sig", "copies", "unit", side.alias("side"),
    )
    found = m.groupBy("t", "cell", "x", "y").applyInPandas(_join_block, "a bigint, b bigint, links bigint")
    found = scratch.keep(found, "links")
    counts = found.where("links >= 0").groupBy("a").agg(F.sum("links").alias("others"))
    roots = components(found.where("links < 0").select("a", "b"), scratch)
    of = classes.select("sig", "copies", "first_id")
    of = of.join(counts, of["sig"] == counts["a"], "left").drop("a")
    of = of.join(roots, of["sig"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sig"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = of.join(least, "root").select(
        "sig", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    of = scratch.keep(of, "classes")
    some = good.join(of, "sig").select("vec_id", "n_links", "component_id")
    none = rows.where(F.col("sig").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    every = some.unionByName(none)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return every.withColumn("kept", kept)


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    return link_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
