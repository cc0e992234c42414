"""Hard negatives against plain scoring of all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from seedgrow.llm import hard_negatives as H


def plain(rows):
    """The contract's result by scoring every row against every anchor."""
    once = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        r = ((label + 1) % 10 if i % 7 == 0 else label, q)
        once[i] = min(once.get(i, r), r)
    out = []
    for a, (la, qa) in once.items():
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(qa, q)), i, lb) for i, (lb, q) in once.items() if i != a and len(q) == len(qa))
        for ps, p, _ in [t for t in s if t[2] == la][:5]:
            ok = [t for t in s if t[2] != la and 80 * -ps <= 100 * -t[0] <= 100 * -ps][:5]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(ok)]
    return sorted(out)


def table(spark, rows, path):
    rows = [(i, label, v and [x if x is None else float(x) for x in v], r) for i, label, v, r in rows]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>, rank string").write.parquet(f"{path}/embeddings.parquet")


def clustered(rng, n, dim, labels):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("block", [16_384, 60])
def test_query_equals_plain_scoring(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(H, "CANDIDATES", block)
    monkeypatch.setattr(H, "ANCHORS", max(3, block // 20))
    monkeypatch.setattr(H, "STRIP", max(16, block // 4))
    rng = random.Random(4)
    rows = clustered(rng, 900, 6, 10)
    rows += [(i, 3, [0.5, 0.5, 0, 0, 0, 0]) for i in range(1000, 1040)]  # ties
    rows += [(1100, None, [1.0] * 6), (1200, 2, None), (1300, 2, [1.0, None, 0, 0, 0, 0]), (1400, 2, [float("nan")] * 6),
             (1500, 2, [float("inf")] * 6), (None, 2, [1.0] * 6), (1600, 2, []), (1700, 2, []), (1800, 5, [1.0, 2.0]), (1801, 6, [1.0, 1.9]),
             (1901, 5, [1.0, 2.0]), (100, 4, [9.0] * 6), (100, 0, [8.0] * 6), (200, rows[200][1], rows[200][2])]
    table(spark, [(*r, "x") for r in rows], str(tmp_path))
    got = sorted(tuple(r) for r in H.op12_negatives(spark, str(tmp_path)).collect())
    assert got == plain(rows)


def test_bounds_spare_scores_and_lose_nothing():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 16)) * 400
    x = np.floor(np.repeat(centres, 250, axis=0) + rng.standard_normal((2000, 16)) * 10).astype(np.int64)
    c = H.Candidates(np.arange(2000), np.zeros(2000, np.int64), x)
    anchors = x[::40]
    best = [[H.Best(5)] for _ in anchors]
    scored = H.walk(H.spanning_tree(anchors.astype(float)), anchors, c, lambda a: np.ones(2000, bool), best)
    assert scored < 0.6 * len(anchors) * 2000
    for a, (b,) in zip(anchors, best):
        s = x @ a
        order = np.lexsort((np.arange(2000), -s))[:5]
        assert b.ids.tolist() == order.tolist() and b.scores.tolist() == s[order].tolist()


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 3))
    order, parent, edge = H.spanning_tree(x)
    assert sorted(order) == list(range(40)) and sum(p < 0 for p in parent) == 1
    pairs = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(40) for j in range(i))
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for d, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert edge.sum() == pytest.approx(total)


def test_scores_beyond_doubles_are_exact():
    x = np.array([[2**30 + 1, 2**30 - 3], [2**62, 2**62], [3, 5]], np.int64)
    c = H.Candidates(np.arange(3), np.zeros(3, np.int64), x)
    a = np.array([2**30 + 7, 2**29 + 11], np.int64)
    want = [min(sum(int(p) * int(q) for p, q in zip(r, a)), 2**63 - 1) for r in x]
    assert c.scores(a, np.arange(3)).tolist() == want


def test_empty_table(spark, tmp_path):
    table(spark, [], str(tmp_path))
    assert H.op12_negatives(spark, str(tmp_path)).count() == 0
