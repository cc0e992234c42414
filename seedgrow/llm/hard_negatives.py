"""Hard negatives by anchor spanning-tree bounds.

A row's score for an anchor is the inner product of their quantised vectors.
The anchors of a block are joined into a minimum spanning tree by Euclidean
distance. The root anchor scores every candidate; for a child anchor c of
parent p, <c, x> = <p, x> + <c - p, x>, so

    score(c, x) lies within score(p, x) +- |c - p| * |x|.

Only candidates whose interval meets a window that the anchor still needs are
scored again; the others carry their interval on to the next child. Windows:
for the positives everything from the fifth best score so far; for the
negatives the scores from 80 % to 100 % of a positive's, from the fifth best so
far in that window. Intervals never exclude a row that belongs to the result,
so it is exact.

Candidates and anchors are dealt into blocks by a hash of their id, and every
pair of an anchor block with a candidate block is one group (the anchors are a
stated query set, one row in a hundred). A group holds at most about
``CANDIDATES`` + ``ANCHORS`` vectors, whatever the labels; each returns its
best rows an anchor, and the best of all groups are ranked once more. First the
positives, then the negatives in the windows that the positives set.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; of rows that share an id the one with the smallest
label, then vector, stands for all; vectors of different lengths never meet;
an anchor without another row of its label gives no rows, nor does a positive
without a negative in its window (a negative positive score has an empty one);
ties are broken by the smaller id. Quantised components and scores that do not
fit a long are held at its ends. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedgrow.llm.common import Scratch, read_table

# The share of the positive's score, in percent, that a negative
# reaches at least and at most; rows taken each; anchors are ids divisible by EVERY.
LOW, HIGH = 80, 100
POSITIVES, NEGATIVES = 5, 5
EVERY = 100
SCALE = 256
# Rows of a block, about, and candidates walked through the tree at once.
CANDIDATES = 16_384
ANCHORS = 1_024
STRIP = 2_048
# Candidates scored before the windows of an anchor are narrowed.
FIRST = 32

_LONG = 2**63 - 1


def spanning_tree(x: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Minimum spanning tree of the rows of ``x`` (Prim): rows in the order
    they join, each one's parent (-1 for the root), and edge lengths."""
    n = len(x)
    sq = (x * x).sum(axis=1)
    far = np.full(n, np.inf)
    parent = np.full(n, -1, np.int64)
    out = np.zeros(n, bool)
    order, at = [], int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    for _ in range(n):
        out[at] = True
        order.append(at)
        d = np.maximum(sq + sq[at] - 2 * (x @ x[at]), 0)
        closer = ~out & (d < far)
        far[closer], parent[closer] = d[closer], at
        if len(order) < n:
            at = int(np.argmin(np.where(out, np.inf, far)))
    # The lengths again without cancellation.
    edge = np.zeros(n)
    kids = parent >= 0
    edge[kids] = np.sqrt(((x[kids] - x[parent[kids]]) ** 2).sum(axis=1))
    return order, parent.tolist(), edge


class Candidates:
    """Candidates of one length, with exact integer scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.ints = ids, labels, vectors
        self.floats = vectors.astype(np.float64)
        self.norms = np.sqrt((self.floats**2).sum(axis=1))
        self.top = float(np.abs(self.floats).max()) if vectors.size else 0.0

    def part(self, rows) -> Candidates:
        return Candidates(self.ids[rows], self.labels[rows], self.ints[rows])

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products with ``anchor``: sums of integers are exact in
        doubles below 2^53, and taken as Python integers beyond."""
        every = len(rows) == len(self.ids)
        a = anchor.astype(np.float64)
        if self.top * (float(np.abs(a).max()) if a.size else 0.0) * max(len(a), 1) < 2**53:
            s = (self.floats if every else self.floats[rows]) @ a
            return np.rint(s).astype(np.int64)
        s = self.ints[rows].astype(object) @ anchor.astype(object)
        return np.array([min(max(int(v), -_LONG - 1), _LONG) for v in s], np.int64)


class Best:
    """The ``k`` best (score, id) so far among scores from ``low`` to ``high``."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)

    @property
    def least(self) -> float:
        """What a further row must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.low) & (scores <= self.high)
        s, i = np.concatenate([self.scores, scores[ok]]), np.concatenate([self.ids, ids[ok]])
        order = np.lexsort((i, ~s))[: self.k]  # ~s falls as s rises, without overflow
        self.scores, self.ids = s[order], i[order]


def walk(tree: tuple, anchors: np.ndarray, c: Candidates, fits, best: list[list[Best]]) -> int:
    """Fill ``best[a]`` of every anchor from the candidates ``c``; ``fits(a)``
    marks the candidates that may be taken. Returns the number of scores
    computed."""
    order, parent, edge = tree
    centre: dict[int, np.ndarray] = {}
    radius: dict[int, np.ndarray] = {}
    left = np.bincount([p for p in parent if p >= 0], minlength=len(parent))
    scored = 0
    for a in order:
        p = parent[a]
        if p < 0:
            mid, rad = np.zeros(len(c.ids)), np.zeros(len(c.ids))
        else:
            # The margin covers the rounding of norms and lengths.
            mid, rad = centre[p].copy(), (radius[p] + edge[a] * c.norms) * (1 + 1e-9)
            rad += 1e-9 * np.abs(mid) * (rad > 0) + 1e-6
            left[p] -= 1
            if not left[p]:
                del centre[p], radius[p]
        may = fits(a)

        def score(rows):
            s = c.scores(anchors[a], rows)
            mid[rows], rad[rows] = s, 0.0
            for b in best[a]:
                b.add(s[may[rows]], c.ids[rows][may[rows]])
            return len(rows)

        if p < 0:
            scored += score(np.arange(len(mid)))
        else:
            open_ = may.copy()
            # The most promising ones first: they narrow the windows.
            for first in (FIRST, len(mid)):
                need = np.zeros(len(mid), bool)
                for b in best[a]:
                    need |= (mid + rad >= b.least) & (mid - rad <= b.high)
                rows = np.flatnonzero(need & open_)
                if len(rows) > first:
                    rows = rows[np.argpartition(-mid[rows], first)[:first]]
                if len(rows):
                    scored += score(rows)
                    open_[rows] = False
        if left[a]:
            centre[a], radius[a] = mid, rad
    return scored


def _vectors(frame) -> np.ndarray:
    return np.stack(frame["q"].to_numpy()).astype(np.int64) if len(frame) else np.empty((0, 0), np.int64)


def _by_length(anchors, candidates):
    """Anchors and candidates of equal vector length."""
    a_len, c_len = anchors["q"].map(len), candidates["q"].map(len)
    for n in sorted(set(a_len) & set(c_len)):
        a, c = anchors[a_len == n], candidates[c_len == n]
        c = Candidates(c["vec_id"].to_numpy(np.int64), c["label"].to_numpy(np.int64), _vectors(c).reshape(len(c), n))
        yield a.reset_index(drop=True), _vectors(a).reshape(len(a), n), c


def _positives(anchors, candidates):
    """The best rows of the anchor's label in this block, a tree a label."""
    import pandas as pd

    out = []
    for a, x, c in _by_length(anchors, candidates):
        for label in sorted(set(a["label"])):
            mine = np.flatnonzero((a["label"] == label).to_numpy())
            same = np.flatnonzero(c.labels == label)
            ids = a["vec_id"].to_numpy(np.int64)[mine]
            tree = spanning_tree(x[mine].astype(np.float64))
            best = [[Best(POSITIVES)] for _ in mine]
            for k in range(0, len(same), STRIP):
                part = c.part(same[k : k + STRIP])
                walk(tree, x[mine], part, lambda i: part.ids != ids[i], best)
            for i, (b,) in zip(ids.tolist(), best):
                out += [(i, p, s) for p, s in zip(b.ids.tolist(), b.scores.tolist())]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])


def _negatives(anchors, candidates):
    """The best rows of other labels in this block in each positive's window."""
    import pandas as pd

    out = []
    for a, x, c in _by_length(anchors, candidates):
        tree = spanning_tree(x.astype(np.float64))
        labels = a["label"].to_numpy(np.int64)
        best = [[Best(NEGATIVES, -(-LOW * s // HIGH), s) for s in sorted({int(p["score"]) for p in ps})]
                for ps in a["positives"]]
        for k in range(0, len(c.ids), STRIP):
            part = c.part(slice(k, k + STRIP))
            walk(tree, x, part, lambda i: part.labels != labels[i], best)
        for i, ps, bs in zip(a["vec_id"].tolist(), a["positives"], best):
            of = {b.high: b for b in bs}
            for p in ps:
                b = of[int(p["score"])]
                out += [(i, int(p["id"]), int(p["score"]), n, s) for n, s in zip(b.ids.tolist(), b.scores.tolist())]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def prepare(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, q``: quantised rows that take part, one an id."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", F.struct(label.alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("q")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def _deal(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Each row in its own block, once for every block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
    )


def mine(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` of every anchor and positive."""
    scratch = Scratch(embeddings.sparkSession, "negatives")
    rows = scratch.keep(prepare(embeddings), "rows")
    anchors = rows.where(F.col("vec_id") % EVERY == 0)
    n, m = rows.count(), anchors.count()
    of_rows, of_anchors = max(1, -(-n // CANDIDATES)), max(1, -(-m // ANCHORS))
    candidates = _deal(rows, "cb", of_rows, "ab", of_anchors).groupBy("ab", "cb")

    def groups(a: DataFrame):
        return _deal(a, "ab", of_anchors, "cb", of_rows).groupBy("ab", "cb").cogroup(candidates)

    found = groups(anchors).applyInPandas(_positives, "anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    positives = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= POSITIVES)
    lists = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives")
    )
    asked = scratch.keep(anchors.join(lists, "vec_id"), "asked")
    found = groups(asked).applyInPandas(
        _negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op12_sql() -> str:
    return f"""
WITH quantised AS (
  SELECT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows_once AS (
  SELECT vec_id, label, q FROM quantised QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, q) = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
         CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM rows_once a JOIN rows_once r ON len(a.q) = len(r.q)
  WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
   AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= {NEGATIVES}
"""
