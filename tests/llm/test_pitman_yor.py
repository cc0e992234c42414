"""The Pitman-Yor model against plain counts, exact seatings and a plain
version of the sweeps."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from seedgrow.llm import pitman_yor as P


def partitions(n):
    """All ways to seat customers 0 .. n - 1."""
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield p[:i] + [p[i] + 1] + p[i + 1 :]
        yield [*p, 1]


@pytest.mark.parametrize("c,others,p,d", [(2, 0, 0.3, 0.5), (4, 3, 0.05, 0.75), (6, 40, 0.2, 0.3)])
def test_draws_follow_the_seatings(c, others, p, d):
    weight = Counter()
    for seats in partitions(c):
        w = 1.0
        for k, size in enumerate(seats):
            w *= (P.STRENGTH + d * (others + k)) * p * math.prod(i - d for i in range(1, size))
        weight[len(seats)] += w
    n = 200_000
    u = (np.arange(n) + 0.5) / n
    t = P.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, u)
    for k in range(1, c + 1):
        assert (t == k).mean() == pytest.approx(weight[k] / sum(weight.values()), abs=2e-5)


@pytest.mark.parametrize("d", [0.3, 0.6, 0.85])
@pytest.mark.parametrize("others,p", [(0, 0.01), (500, 0.01), (5000, 0.01), (100_000, 0.001), (100_000, 0.01), (20, 0.5)])
def test_large_dishes_meet_the_exact_mean(monkeypatch, d, others, p):
    """The limit used for large dishes against the exact conditional."""
    monkeypatch.setattr(P, "EXACT", 200)
    P.stirling.cache_clear()
    rng = np.random.default_rng(1)
    args = (np.full(2000, 200), np.full(2000, others), np.full(2000, p), d)
    exact = P.draw_tables(*args, rng.random(2000))
    limit = P._draw_large(*args, rng.random(2000))
    P.stirling.cache_clear()
    assert limit.mean() == pytest.approx(exact.mean(), rel=0.25)


def test_draws_stay_between_one_and_the_customers():
    c = np.array([0, 1, 2, 64, 65, 10**6, 10**9, 10**12])
    for p in (1e-12, 1e-3, 0.999):
        for others in (0, 10**6):
            t = P.draw_tables(c, np.full(8, others), np.full(8, p), 0.7, np.linspace(0, 1, 8, endpoint=False))
            assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0


def plain_rows(rows):
    """The whole query, word by word."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    docs = [(i, [w.lower() for w in (t or "").encode().split()] + [b" "]) for i, t in rows]
    counts, pairs = Counter(), Counter()
    for i, ws in docs:
        if not held[i]:
            counts.update(ws)
            pairs.update(zip([b"\n", *ws], ws))
    n, v = sum(counts.values()), len(counts)
    cu, du, start = Counter(), Counter(), Counter()
    for (u, w), c in pairs.items():
        cu[u] += c
        du[u] += 1
        start[w] += 1
    d1 = P.discount(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    d2 = P.discount(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    key = {w: np.array([xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64) for w in [*counts, b"\n"]}
    base = 1 / (v + 1)

    def draw(c, others, p, d, uniform):
        return int(P.draw_tables(np.array([c]), np.array([others]), np.array([p]), d, uniform)[0])

    customers, samples = dict(start), []
    for sweep in range(P.BURN + P.SAMPLES):
        t = {}
        for (u, w), c in pairs.items():
            p = customers[w] / (P.STRENGTH + len(pairs))
            t[u, w] = draw(c, du[u] - 1, p, d2, P._uniform(sweep, key[u], key[w]))
        customers = Counter()
        for (u, w), k in t.items():
            customers[w] += k
        if sweep >= P.BURN:
            s = sweep - P.BURN
            tables = {w: draw(c, v - 1, base, d1, P._uniform(1000 + s, key[w], key[w])) for w, c in customers.items()}
            inside = Counter()
            for (u, w), k in t.items():
                inside[u] += k
            samples.append((t, inside, dict(customers), tables))

    def probability(u, w):
        total = 0.0
        for t, inside, customers, tables in samples:
            top = sum(tables.values())
            p1 = (customers.get(w, 0) - d1 * tables.get(w, 0) + (P.STRENGTH + d1 * top) * base) / (P.STRENGTH + sum(customers.values()))
            total += (pairs.get((u, w), 0) - d2 * t.get((u, w), 0) + (P.STRENGTH + d2 * inside.get(u, 0)) * p1) / (P.STRENGTH + cu.get(u, 0))
        return total / len(samples)

    for u in [b"\n", *list(counts)[:20], b"never seen"]:
        assert sum(probability(u, w) for w in [*counts, b"another"]) == pytest.approx(1)
    out = []
    for i, ws in docs:
        out.append((i, held[i], len(ws), sum(counts[w] > 0 for w in ws), n,
                    sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws),
                    sum(math.log10(probability(u, w)) for u, w in zip([b"\n", *ws], ws))))
    return out


def corpus():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)] + ["The", "the", "Ünï", "Éa"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 40)))) for i in range(70)]
    return rows + [(70, None), (71, ""), (None, "the w1 w2"), (72, "hot " * 300), (73, "hot hot"), (73, "hot hot"), (74, "a \x0b\x0c\r\n new\twordnull")]


def check(got, want):
    order = lambda r: tuple(str(x) for x in r[:4])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert tuple(g[5:]) == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("batch,bucket", [(1_500_000, 1_000_000), (60, 90)])
def test_query_equals_plain_sweeps(spark, tmp_path, monkeypatch, batch, bucket):
    monkeypatch.setattr(P, "BATCH", batch)
    monkeypatch.setattr(P, "BUCKET", bucket)
    rows = corpus()
    spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, words int").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = P.op11_pitman_yor(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check([tuple(r) for r in got.collect()], plain_rows(rows))


def test_spread_words_change_little(spark, monkeypatch):
    """Words spread over several buckets change the parent's probability in
    their draws, and with it the scores, but little."""
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    plain = {str(r[:3]): r["score"] for r in P.score_documents(docs).collect()}
    monkeypatch.setattr(P, "BUCKET", 90)
    monkeypatch.setattr(P, "BATCH", 60)
    monkeypatch.setattr(P, "SPREAD_LEAST", 20)
    spread = {str(r[:3]): r["score"] for r in P.score_documents(docs).collect()}
    assert plain.keys() == spread.keys() and plain != spread
    assert sum(spread.values()) == pytest.approx(sum(plain.values()), rel=0.02)


def test_spread_words_change_no_score(spark, monkeypatch):
    """Whether a word is spread over several buckets, which depends on the
    size of the input, has no effect on the rows."""
    rows = corpus() * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(P, "BUCKET", 90)
    monkeypatch.setattr(P, "BATCH", 60)
    for least in (1, 20):
        monkeypatch.setattr(P, "SPREAD_LEAST", least)
        check([tuple(r) for r in P.score_documents(docs).collect()], plain_rows(rows))


def test_model_beats_single_words_on_held_out_texts(spark):
    rows = [r for r in P.op11_pitman_yor(spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)


def test_nothing_learned_and_empty_table(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    d = spark.createDataFrame([(i, "a b a") for i in held], "doc_id int, text string")
    rows = P.score_documents(d).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows} == {(4, 0, 0, 0.0)}
    assert P.score_documents(d.limit(0)).count() == 0


def test_numbers_travel_packed():
    """Pairs go to the buckets at far less than 8 bytes a number, and whole."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    for x in ([], [0], [-1, 127], [128], [-40_000, 3], [2**31], [-(2**63), 2**63 - 1]):
        assert P._unpack(P._pack(np.array(x, np.int64))).tolist() == x
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 2000)) for _ in range(5)]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "held": [False] * 4 + [True], "text": texts})
    of = pyspark.TaskContext.get
    pyspark.TaskContext.get = staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0))
    try:
        batches = list(P._batches(iter([rows]), 1 << 20))
    finally:
        pyspark.TaskContext.get = of
    sent = list(P._send(iter(batches), 3, np.empty(0, np.int64)))
    learned = {}
    for b in sent:
        for r in b.to_pylist():
            a, times, words, counts, place = (P._unpack(r[k]) for k in "abcde")
            for u, w, c in zip(np.repeat(a, times).tolist(), words[place].tolist(), counts.tolist()):
                learned[u, w] = learned.get((u, w), 0) + c
    assert sum(learned.values()) == 4 * 2001
    size = sum(len(r[k]) for b in sent for r in b.to_pylist() for k in "abcde")
    assert size < 16 * len(learned) / 2
