"""Jaccard join, embedding links and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedgrow.llm import components, embedding_dedup, jaccard_join
from seedgrow.llm.common import Scratch

SF = "/root/testdata/sf0.01"


class Union:
    def __init__(self, nodes):
        self.parent = {x: x for x in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_join(rows):
    sets = {i: shingles(t) for i, t in rows}
    u, ids = Union(sets), sorted(sets)
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    seen = set()
    for owners in by.values():
        for k, b in enumerate(owners):
            for a in owners[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                        u.join(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(jaccard_join.op4_jaccard(spark, SF)) == brute_join(rows)


def near_copies(rng, groups, size, shared):
    """Groups of edited copies; half the documents also hold a common passage."""
    passage = [f"common{i}" for i in range(shared)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.randint(30, 90))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                w = w + passage
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("limit", [2000, 12], ids=["one task", "pivots, cells and blocks"])
def test_large_regions_are_exact(spark, monkeypatch, limit):
    rows = near_copies(random.Random(5), 12, 40, 60)
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", limit)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    monkeypatch.setattr(jaccard_join, "LEVELS", 2)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(jaccard_join.join_classes(d)) == brute_join(rows)


def test_members_of_one_distance_are_not_copied_again_and_again(spark, monkeypatch):
    """Where all members are about as far from one another, cells split
    nothing; the region goes to pairs of blocks, not to cells of cells."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        # Runs of edits at the end leave the front in common; links are rare.
        for k in rng.sample(range(12, 60, 6), 2):
            w[k] = f"e{rng.randrange(40)}x{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 40)
    kept, keep = {}, Scratch.keep

    def counting(self, df, name="t", partition_by=None):
        out = keep(self, df, name, partition_by)
        kept.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counting)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(jaccard_join.join_classes(d)) == brute_join(rows)
    assert max(kept["distances"]) <= (jaccard_join.PIVOTS + 1) * max(kept["sets"])


ODD = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (None, "x y z q r s"), (None, "x y z q r s"),
       (3, None), (4, ""), (4, ""), (5, "x y z q r s"), (6, "one two"), (6, "other words here"),
       (None, "lonely text of null id"), (7, "one  two"), (8, "long " * 40000)]


def test_small_regions_get_each_set_once(spark, monkeypatch):
    """Copies in many tasks do not multiply what a region's task holds."""

    def checked(join):
        def once(batches):
            seen = set()

            def watched():
                for b in batches:
                    for r in b.drop_columns("items").to_pylist():
                        key = (r["region"], r.get("part"), r["sig"])
                        assert key not in seen, "a set came twice"
                        seen.add(key)
                    yield b

            yield from join(watched())

        return once

    for name in ("_to_pivot", "_join_region"):
        monkeypatch.setattr(jaccard_join, name, checked(getattr(jaccard_join, name)))
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-1], "y"])]
    rows = [(i, t) for _ in range(8) for i, t in enumerate(texts)]
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    docs, classes = jaccard_join._joined(d)
    assert docs.count() == 24 and classes.select("component_id").distinct().count() == 1


def test_sketches_never_reject_a_linked_pair():
    rng = np.random.default_rng(4)
    linked = rejected = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        part = rng.choice([0.0, 0.5, 0.75, 0.86, 0.95])
        y = np.unique(np.concatenate([x[rng.random(len(x)) < part], rng.integers(0, 1 << 64, max(1, int(n * (1 - part))), dtype=np.uint64)]))
        size = 4 * min(len(jaccard_join.sketch(x)), len(jaccard_join.sketch(y)))
        c = jaccard_join._counts(jaccard_join.sketch(x), size)[None]
        k = np.array([len(x)])
        may = jaccard_join._may_link(c, k, k - c.sum(), jaccard_join._counts(jaccard_join.sketch(y), size), len(y))[0]
        common = len(np.intersect1d(x, y))
        is_linked = 100 * common >= 75 * (len(x) + len(y) - common)
        assert may or not is_linked
        linked, rejected = linked + is_linked, rejected + (not may)
    assert linked > 300 and rejected > 1000


def test_odd_rows(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.join_classes(d).collect()), key=repr)
    want = [(1, 3, 1), (1, 3, 1), (2, 3, 1), (0, 2, 5), (0, 2, 5), (3, 0, 3), (4, 0, 4), (4, 0, 4), (5, 2, 5), (6, 1, 6), (6, 1, 6),
            (0, 1, None), (7, 1, 6), (8, 1, 8)]
    assert got == sorted(want, key=repr)
    kept = sorted(((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in jaccard_join.first_of_each(d).collect()), key=repr)
    assert kept == sorted([(1, "a b c d e"), (3, ""), (4, ""), (4, ""), (5, "x y z q r"), (6, "one two"), (6, "other wor"),
                           (0, "lonely te"), (8, "long long")], key=repr)
    e = d.limit(0)
    assert jaccard_join.join_classes(e).count() == jaccard_join.first_of_each(e).count() == 0


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, x) for x in range(201, 300)] + [(5, 5), (400, 401), (401, 400)]
    rng.shuffle(edges)
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    got = {r["node"]: r["root"] for r in got.collect()}
    assert got == {x: u.find(x) for x in got} and set(got) == {x for e in edges for x in e if e[0] != e[1]}
    none = components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"))
    assert none.count() == 0


def brute_links(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    u = Union(ids)
    for a, b in zip(*np.nonzero(near)):
        u.join(ids[a], ids[b])
    return near, {i: (int(n), u.find(i), u.find(i) == i) for i, n in zip(ids, near.sum(axis=1))}


@pytest.mark.parametrize("region", [2000, 40], ids=["one task", "blocks"])
def test_embeddings_against_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(embedding_dedup, "REGION", region)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 64))
    hot = base[0] + 0.02 * rng.standard_normal((150, 64))
    some = np.repeat(base[1:30], 3, axis=0) * 3 + 0.05 * rng.standard_normal((87, 64))
    x = np.concatenate([base, hot, some, base[:5] * 2, base[:5]])
    ids = [int(i) for i in rng.permutation(len(x))]
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(d).collect()}
    assert got == brute_links(ids, x)[1]


def test_recall_near_the_threshold(spark):
    """Pairs of cosine 0.95 to 0.96: the hardest ones."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9501 + 0.0099 * rng.random()
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = got.where("n_links > 0").count() / len(rows)
    print("recall at the threshold:", found)
    assert found >= 0.95
    assert embedding_dedup.tables_recall() > 0.98


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]),
            (8, [1.0, 0.0]), (9, [1e-300, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [0.0, 5.0]), (12, [-1.0, 0.0]), (7, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(d).collect()), key=repr)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 12)]
    want += [(7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (9, 3, 7, False), (0, 0, None, True)]
    assert got == sorted(want, key=repr)
    assert embedding_dedup.link_vectors(d.limit(0)).count() == 0
