"""Periodic runs against plain comparison at every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedgrow.llm import runs


def brute(words):
    """Every run of at least 12 words, by start, then period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= 12:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def nested(rng, letters, blocks, times):
    """Words with repetitions inside repetitions."""
    out = []
    for _ in range(blocks):
        p = [rng.choice(letters) for _ in range(rng.randint(1, 4))] * rng.randint(1, times)
        p += [rng.choice(letters) for _ in range(rng.randint(0, 2))]
        out += p * rng.choice([1, 1, 2, 3, 5])
    return out


def test_random_sequences():
    rng = random.Random(3)
    docs = [[rng.choice("ab") for _ in range(rng.randint(0, 150))] for _ in range(40)]
    docs += [[rng.choice("abc") for _ in range(rng.randint(0, 150))] for _ in range(40)]
    docs += [nested(rng, rng.choice(["ab", "abc", "abcdefgh"]), rng.randint(1, 8), rng.choice([3, 14])) for _ in range(60)]
    for d, got in zip(docs, runs.runs_of(docs)):
        assert got == brute(d), "".join(d)


@pytest.mark.parametrize("p,times", [(1, 400), (2, 200), (3, 100), (5, 61), (37, 9), (150, 3), (211, 2)])
def test_large_periods_and_halves_that_break_once(p, times):
    rng = random.Random(p)
    block = [str(rng.randint(0, 10**9)) for _ in range(p)]
    once = [str(rng.randint(0, 10**9)) for _ in range(50)]
    docs = [once + block * times + once, block * times + block[: p // 2], (block * times + ["x"]) * 2,
            (block * times + block[: (p + 1) // 2]) * 2]
    for d, got in zip(docs, runs.runs_of(docs)):
        assert got == brute(d)


def test_without_members_runs_are_lost(monkeypatch):
    """The synchronising sets do the work for periods of 6 and more."""
    rng = random.Random(8)
    block = [str(rng.random()) for _ in range(40)]
    assert runs.runs_of([block * 3]) == [[(0, 120, 40)]]
    monkeypatch.setattr(runs, "_members", lambda h, tau, regions: np.empty(0, np.int64))
    assert runs.runs_of([block * 3]) == [[]]


def test_members_follow_their_context():
    rng = random.Random(5)
    piece = [rng.randint(0, 10**6) for _ in range(300)]
    seq = np.array([rng.randint(0, 10**6) for _ in range(77)] + piece + [rng.randint(0, 10**6) for _ in range(131)] + piece, np.int64)
    h = runs._mix(seq.astype(np.uint64))
    for width in (1, 2, 4):
        h = runs._mix(h[:-width] * np.uint64(3) + h[width:])
    at = set(runs._members(h, 8, (np.empty(0, np.int64),) * 3).tolist())
    first, second = 77, 77 + 300 + 131
    inner = [k for k in range(300 - 16)]
    assert [first + k in at for k in inner] == [second + k in at for k in inner]
    assert all(any(i + d in at for d in range(8)) for i in range(len(seq) - 24))


def plain(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    r = brute(words)
    gone = {i for s, length, q in r for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in r)
    return (doc_id, len(r), best[0], best[1], best[2], 1000 * best[1] // best[2] if r else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_plain_comparison(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["a", "b", "the", "Ünï", " x"]
    rows = [(i, rng.choice([" ", "\n", "\t \r"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))), "k") for i in range(120)]
    rows += [(500, None, "k"), (501, "", "k"), (502, " \x0b\x0c\r\n", "k"), (None, "w " * 40, "k"), (7, "w " * 40, None), (7, "w " * 40, None),
             (600, " ".join(str(i % 997) for i in range(4000)), "k")]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in runs.op13_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain(d, t) for d, t, _ in rows), key=str)


def test_empty_table_and_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert runs.detect_runs(empty).count() == 0
    d = spark.createDataFrame([(1, "x y z a b c d e f g h i j k " + "one two three " * 5 + "end")], "doc_id int, text string")
    row = runs.detect_runs(d).first()
    assert row["collapsed"] == "x y z a b c d e f g h i j k one two three end"
    assert [tuple(r) for r in row["runs"]] == [(14, 15, 3)]


def test_batches_do_not_change_results(spark, monkeypatch):
    rng = random.Random(2)
    docs = [nested(rng, "abcd", rng.randint(0, 6), 6) for _ in range(80)]
    whole = runs.runs_of(docs)
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    assert runs.runs_of(docs) == whole
    got = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    rows = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.detect_runs(got.repartition(3)).select("doc_id", F.col("runs")).collect()}
    assert [rows[i] for i in range(len(docs))] == whole


def test_a_run_is_compared_once(monkeypatch):
    """Not once for each of the members inside it."""
    rng = random.Random(4)
    block = [str(rng.random()) for _ in range(40)]
    compared = []
    exact = runs._exact
    monkeypatch.setattr(runs, "_exact", lambda *a: (compared.append(a), exact(*a))[1])
    assert runs.runs_of([block * 60]) == [[(0, 2400, 40)]]
    assert len(compared) < 10


def test_misleading_hashes_change_nothing(monkeypatch):
    rng = random.Random(6)
    docs = [nested(rng, "abcdefgh", 6, 5) for _ in range(20)]
    block = [str(rng.random()) for _ in range(30)]
    docs.append(block * 3 + ["x"] + block * 2)
    whole = runs.runs_of(docs)
    assert whole == [brute(d) for d in docs]
    monkeypatch.setattr(runs._Sequence, "equal", lambda self, i, q, length: np.ones(len(i), bool))
    assert runs.runs_of(docs) == whole
