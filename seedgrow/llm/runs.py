"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal)
and length at least 2 q that no neighbouring word extends. All runs of all
documents of a batch are found together, on one sequence in which a word of
its own follows every document, so no run crosses documents.

Scale tau = 2, 4, 8, ... looks for periods 3 tau <= q < 6 tau:

1. A *synchronising set* is chosen by hash: position i belongs to it if the
   smallest hash among the tau-word windows at i .. i + tau is the one at i or
   at i + tau. Windows inside a *highly periodic region* (period at most
   tau / 3) do not take part. So membership depends on the next 2 tau words
   only, and every tau consecutive positions hold a member unless 3 tau - 1
   words from the first one are highly periodic.
2. Two members with equal contexts (2 tau words), q apart, propose period q. A
   run of period q contains such a pair: its first members repeat one period
   later. Contexts are not highly periodic, so a member has a bounded number of
   equal partners closer than 6 tau.
3. The pair is extended in both directions as long as words q apart agree.

What the members cannot propose is supplied by the highly periodic regions
themselves: periods below 6, which no scale covers, by comparing the sequence
with itself shifted; and runs whose two halves are regions of one smaller
period that break only where they meet: two touching regions of equal period
propose every shift that aligns their words.

Extension compares prefix sums of two modular hashes by binary search; each
run found is then compared word by word, and searched plainly if the hashes
misled it, so the result is exact.

Edge cases: a null or empty text, or one without words, has no run; equal texts
give equal runs; very long texts are handled whole (work and memory grow with
n log n and n); repeated rows and null ids are kept as rows of their own; an
empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.llm.common import read_table

# Fixed value: shortest length of a reported run.
MIN_LENGTH = 12
# Words handled together (a longer document is handled alone, whole).
BATCH_WORDS = 1_000_000
# Periods below 3 * (first scale) are found by shifting.
FIRST_SCALE = 2

_P = (np.uint64(2_147_483_647), np.uint64(2_147_483_629))
_B = (np.uint64(911_382_323), np.uint64(972_663_749))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sequence:
    """Words as numbers, with hashes of every stretch."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.powers = [], []
        for p, b in zip(_P, _B):
            pw = np.ones(max(n, 1), np.uint64)
            k, step = 1, b
            while k < n:
                m = min(k, n - k)
                pw[k : k + m] = pw[:m] * step % p
                step, k = step * step % p, 2 * k
            v = _mix(words.astype(np.uint64) + np.uint64(1)) % p * pw[:n] % p
            self.powers.append(pw)
            self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(v, dtype=np.uint64))))

    def equal(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from i equal those from i + q, by hash."""
        ok = np.ones(len(i), bool)
        for s, pw, p in zip(self.sums, self.powers, _P):
            a = (s[i + length] - s[i]) % p * pw[q] % p
            ok &= a == (s[i + q + length] - s[i + q]) % p
        return ok

    def extend(self, i: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest [a, b) around each i in which words equal those q later
        (a = b = i where even word i differs), among the first n words."""
        right = np.zeros(len(i), np.int64)
        room = n - q - i
        left = np.zeros(len(i), np.int64)
        k = 1 << max(n, 1).bit_length()
        while k:
            t = right + k
            ok = t <= room
            ok[ok] = self.equal(i[ok], q[ok], t[ok])
            right[ok] = t[ok]
            t = left + k
            ok = t <= i
            ok[ok] = self.equal(i[ok] - t[ok], q[ok], t[ok])
            left[ok] = t[ok]
            k >>= 1
        return i - left, i + right


def _small_periods(words: np.ndarray, below: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of period 1 .. below - 1, at least two periods long."""
    found = []
    for q in range(1, min(below, len(words) // 2 + 1)):
        same = np.zeros(len(words) - q + 2, np.int8)
        same[1:-1] = words[q:] == words[:-q]
        edge = np.diff(same)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ok = b - a >= q
        found.append((a[ok], b[ok] + q, np.full(int(ok.sum()), q, np.int64)))
    return found


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w consecutive values."""
    m = -(-len(x) // w) * w
    top = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    top[: len(x)] = x
    rows = top.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def _members(h: np.ndarray, tau: int, regions: tuple) -> np.ndarray:
    """The synchronising set of scale tau; ``h`` hashes every tau words."""
    start, end, period = regions
    inside = np.zeros(len(h) + 1, np.int64)
    deep = (3 * period <= tau) & (end - start >= tau) & (start < len(h))
    np.add.at(inside, start[deep], 1)
    np.add.at(inside, np.minimum(end[deep] - tau + 1, len(h)), -1)
    value = np.where(np.cumsum(inside[:-1]) > 0, np.uint64(0xFFFFFFFFFFFFFFFF), h)
    least = _window_min(value, tau + 1)
    n = len(least)
    return np.flatnonzero(((least == value[:n]) | (least == value[tau : tau + n])) & (least != np.uint64(0xFFFFFFFFFFFFFFFF)))


def _pairs(at: np.ndarray, context: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) of members with equal contexts, 3 tau <= q < 6 tau apart."""
    order = np.argsort(context, kind="stable")
    pos, ctx = at[order], context[order]
    i_out, q_out = [], []
    live = np.arange(len(pos))
    k = 0
    while len(live):
        k += 1
        live = live[live + k < len(pos)]
        far = pos[live + k] - pos[live]
        near = (ctx[live + k] == ctx[live]) & (far < 6 * tau)
        live, far = live[near], far[near]
        use = far >= 3 * tau
        i_out.append(pos[live[use]])
        q_out.append(far[use])
    if not i_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(i_out), np.concatenate(q_out)


def _touching(words: np.ndarray, regions: tuple, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) proposed by pairs of touching highly periodic regions."""
    start, end, period = regions
    deep = (3 * period <= tau) & (end - start >= 3 * tau - 1)
    start, end, period = start[deep], end[deep], period[deep]
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    meet = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]))
    i_out, q_out = [], []
    for k in meet.tolist():
        b1, e1, b2, e2, p = (int(v) for v in (start[k], end[k], start[k + 1], end[k + 1], period[k]))
        tail = words[e1 - p : e1]
        for y in range(b2, b2 + p):
            if np.array_equal(words[y : y + p], tail):
                break
        else:
            continue
        top = min(e1 - b1, e2 - b2, (e2 - b1) // 2, 6 * tau - 1)
        q = np.arange((y - (e1 - p)) % p, top + 1, p)
        q = q[q >= 3 * tau]
        i_out.append(np.maximum(b1, b2 - q))
        q_out.append(q)
    if not i_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(i_out), np.concatenate(q_out)


def _exact(words: np.ndarray, a: int, b: int, q: int, at: np.ndarray) -> list[tuple[int, int]]:
    """[a, b), proposed from the places ``at``, as compared word by word."""
    n = len(words)
    if np.array_equal(words[a:b], words[a + q : b + q]) and (a == 0 or words[a - 1] != words[a - 1 + q]) and (
        b + q == n or words[b] != words[b + q]
    ):
        return [(a, b)]
    differ = np.flatnonzero(words[: n - q] != words[q:])
    found = set()
    for i in at.tolist():
        k = int(np.searchsorted(differ, i))
        if k == len(differ) or differ[k] != i:
            found.add((int(differ[k - 1]) + 1 if k else 0, int(differ[k]) if k < len(differ) else n - q))
    return sorted(found)


def _proposed(i: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> Iterator:
    """Each distinct ``a, b, q`` with the places it was proposed from."""
    order = np.lexsort((q, b, a))
    i, a, b, q = i[order], a[order], b[order], q[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (q[1:] != q[:-1])
    first = np.flatnonzero(new)
    yield from zip(a[first].tolist(), b[first].tolist(), q[first].tolist(), np.split(i, first[1:]))


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of every run of at least MIN_LENGTH words.

    ``words`` is the sequence of all documents, largest first, each followed
    by a number that occurs nowhere else; ``sizes`` are their lengths in
    words. Ordered by start, then period.
    """
    regions = _small_periods(words, 3 * FIRST_SCALE)
    tau = FIRST_SCALE
    h = _mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    width = 1
    seq = None
    while True:
        # Documents too short for two periods of this scale take no part.
        n = int((sizes[sizes >= 6 * tau] + 1).sum())
        if n < 6 * tau:
            break
        while width < tau:
            h = _mix(h[:-width] * np.uint64(3) + h[width:])
            width *= 2
        known = tuple(np.concatenate(c) for c in zip(*regions)) if regions else (np.empty(0, np.int64),) * 3
        part = words[:n]
        here = h[: n - tau + 1]
        at = _members(here, tau, known)
        at = at[at + 2 * tau <= n]
        i, q = _pairs(at, here[at] * np.uint64(5) ^ _mix(here[at + tau]), tau)
        mine = known[1] <= n
        j, r = _touching(part, tuple(c[mine] for c in known), tau)
        i, q = np.concatenate([i, j]), np.concatenate([q, r])
        if len(i):
            # Only the part long enough for this scale is extended; the parts of
            # later scales are shorter, so one set of sums serves them all.
            seq = seq or _Sequence(part)
            a, b = seq.extend(i, q, n)
            ok = b - a >= q
            i, a, b, q = i[ok], a[ok], b[ok], q[ok]
            new = set()
            # All places inside one run lead to it; it is compared once.
            for a1, b1, q1, from_ in _proposed(np.maximum(a, np.minimum(i, b - 1)), a, b, q):
                new.update((x, y + q1, q1) for x, y in _exact(part, a1, b1, q1, from_) if y - x >= q1)
            if new:
                regions.append(tuple(np.array(c, np.int64) for c in zip(*new)))
        tau *= 2
    if not regions:
        return (np.empty(0, np.int64),) * 3
    start, end, period = (np.concatenate(c) for c in zip(*regions))
    ok = end - start >= MIN_LENGTH
    start, end, period = start[ok], end[ok], period[ok]
    # A multiple of a run's period covers the same words: the smallest stays.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(documents: list[list]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each list of words, by
    start, then period."""
    out: list[list] = [[] for _ in documents]
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    k = 0
    while k < len(order):
        take, total = [], 0
        while k < len(order) and (not take or total + len(documents[order[k]]) <= BATCH_WORDS):
            take.append(order[k])
            total += len(documents[order[k]])
            k += 1
        if total < MIN_LENGTH:
            break
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        seq = np.empty(total + len(take), np.int64)
        sizes = np.array([len(documents[d]) for d in take], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        for x, d in enumerate(take):
            o = int(offsets[x])
            seq[o : o + len(documents[d])] = np.fromiter(map(number.__getitem__, documents[d]), np.int64, len(documents[d]))
            seq[o + len(documents[d])] = -1
        marks = seq < 0
        seq[marks] = len(number) + np.arange(len(take))
        start, end, period = find_runs(seq, sizes)
        whose = np.searchsorted(offsets, start, "right") - 1
        for d, s, e, q in zip(whose.tolist(), start.tolist(), end.tolist(), period.tolist()):
            out[take[d]].append((s - int(offsets[d]), e - s, q))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that no run repeats: a word goes if some run
    contains it after that run's first period."""
    gone = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:-1]) == 0)


def _planted(doc_id, words: list) -> list:
    """The words of a document under the rule of ``op13_runs``: of every tenth
    document, by crc32 of its id, the words from some place on repeat."""
    import zlib

    n = len(words)
    if not n or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def _rows(batches: Iterator, planted: bool) -> Iterator:
    import pyarrow as pa

    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def flush(kind, ids, docs):
        found = runs_of(docs)
        collapsed = [b" ".join([w[i] for i in kept_words(len(w), r).tolist()] if r else w) for w, r in zip(docs, found)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, kind),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], run_type),
                pa.array([c.decode() for c in collapsed], pa.string()),
            ],
            ["doc_id", "runs", "collapsed"],
        )

    for b in batches:
        kind = b.column("doc_id").type
        ids, docs, total = [], [], 0
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
            t = t.as_py()
            words = t.encode().split() if t else []
            docs.append(_planted(d, words) if planted else words)
            ids.append(d)
            total += len(words)
            if total >= BATCH_WORDS:
                yield flush(kind, ids, docs)
                ids, docs, total = [], [], 0
        if docs:
            yield flush(kind, ids, docs)


SCHEMA = "doc_id {}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def detect_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row of ``docs``: the runs by start,
    then period, and the words that stay once every run is reduced to its
    first period, joined by one space. With ``planted`` some
    documents first get a run by the rule of ``op13_runs``."""
    d = docs.select("doc_id", "text")
    schema = SCHEMA.format(d.schema["doc_id"].dataType.simpleString())
    return d.mapInArrow(lambda it: _rows(it, planted), schema)


def op13_runs(spark, sf_dir: str) -> DataFrame:
    d = detect_runs(read_table(spark, sf_dir, "documents"), planted=True)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                              r["period"].cast("string")), F.lit("\n")))
    # Longest run, then smallest start, then smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("q"))))
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                 F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.select(
        "doc_id", "n_runs",
        F.col("best.s").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.q").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.n") / F.col("best.q")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
