"""Word scores of a hierarchical Pitman-Yor language model.

The model is a bigram one. Every previous word (or the start of a text) is a
context with a restaurant of its own; a word is a dish. All context restaurants
share one parent, the restaurant of single words, whose parent is uniform over
the V known words and one unknown word. With c customers at t tables for a dish
and c., t. in the restaurant,

    P(w | u) = (c - d t + (strength + d t.) P(w | parent of u)) / (strength + c.)

and each table of a context is one customer of the parent.

**Seating.** A dish's tables are drawn by Gibbs from their conditional given all
other seats (``draw_tables``: up to ``EXACT`` customers from the exact
conditional, by generalised Stirling numbers; larger dishes from its limit, a
negative binomial, within a fifth of the exact mean). One sweep draws all dishes, given the
parent's probabilities after the last sweep and the contexts' tables when every
dish has one; ``BURN`` sweeps are discarded and ``SAMPLES`` kept. A dish with one
customer has one table always. Each draw is a pure function of its inputs and of
a uniform hashed from (sweep, context, word). So where a document is scored the
same seats are drawn again from the dish's count and a few numbers a word, in
place of sending every dish's tables there, and in every sample the
probabilities over all words sum to one. A text's score is the sum over its
tokens of log10 of the probability averaged over the samples.

**Data flow.** Documents are cut into batches of about ``BATCH`` tokens, written
as numbers into the batch's own word list. A batch sends its distinct pairs,
with their training counts, to buckets by context; the bucket adds up the counts
and answers every batch. Dishes with two or more customers go to buckets by word
for the sweeps. Word numbers come back to each batch by a join, and the batch
scores its documents. Words of at least 1 / ``HEAVY`` of all training tokens (so at
most that many) are spread over the buckets of their other word. Their customers
are added up over the buckets after each sweep, one small job a sweep, and given
to the next, so that which words are spread, and how many buckets there are, has
no effect on any result. All of the corpus is used; state between steps is
written under ``spark.checkpoint.dir``.

Words are told apart by 64-bit hashes. Discounts come from the counts of words
and pairs that occur once and twice.

Edge cases: a null or empty text has the end token only; a null id is learned
from and not held out; repeated rows count and are scored as often as they
occur; without training documents every token is unknown; very long texts form a
batch of their own; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedgrow.llm.common import Scratch, read_table

# Sweeps discarded and kept, strength of every restaurant.
BURN, SAMPLES = 2, 3
STRENGTH = 1.0
# Dishes up to this size are drawn from their exact conditional.
EXACT = 64
# Tokens of a batch; tokens a bucket; share and least number of the tokens of a
# spread word.
BATCH = 1_500_000
BUCKET = 1_000_000
HEAVY = 1 << 16
SPREAD_LEAST = 100_000

_END, _START = b" ", b"\n"  # no word holds white space
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) if x.dtype == np.int64 else x
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _uniform(sweep: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    salt = np.uint64(0x9E3779B97F4A7C15 * (sweep + 1) % 2**64)
    h = _mix(_mix(u) + _mix(w + np.int64(1)) * np.uint64(3) + salt)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


# ---------------------------------------------------------------- seating

@lru_cache(maxsize=8)
def stirling(d: float) -> np.ndarray:
    """log S_d(c, t), generalised Stirling numbers, for c, t <= EXACT:
    S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t), S(0, 0) = 1."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(EXACT):
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)) + s[c], -np.inf)
            s[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], s[c, :-1])))
    return s


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, uniform: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers, drawn given that the other
    dishes of the restaurant have ``others`` tables and the parent serves the
    dish with probability ``p``. All arguments but ``d`` are arrays."""
    t = np.minimum(c, 1).astype(np.int64)
    logs = stirling(d)
    small = np.minimum(c, EXACT + 1).astype(np.uint16)
    order = np.argsort(small, kind="stable")
    sizes, first = np.unique(small[order], return_index=True)
    ends = np.append(first[1:], len(c))
    for size, lo, hi in zip(sizes.tolist(), first.tolist(), ends.tolist()):
        if size < 2 or size > EXACT:
            continue
        for k in range(lo, hi, 1 << 14):
            at = order[k : min(hi, k + (1 << 14))]
            t[at] = _draw_small(size, others[at], p[at], d, uniform[at], logs[size])
    large = np.flatnonzero(c > EXACT)
    if len(large):
        t[large] = _draw_large(c[large], others[large], p[large], d, uniform[large])
    return np.clip(t, np.minimum(c, 1), c)


def _draw_small(size: int, others, p, d, uniform, logs) -> np.ndarray:
    """Tables of dishes with ``size`` customers from their exact conditional:
    t tables weigh S_d(size, t) times the product over k < t of
    (strength + d (others + k)) p, here as multiples of the weight of one."""
    first, more = (STRENGTH + d * others) * p, d * p
    steps = np.exp(logs[2 : size + 1] - logs[1:size])
    weight = np.ones(len(p))
    below = np.ones((size, len(p)))
    with np.errstate(over="ignore"):
        for k, step in enumerate(steps.tolist(), 1):
            weight *= step * (first + k * more)
            np.add(below[k - 1], weight, out=below[k])
    t = 1 + np.count_nonzero(below < uniform * below[-1], axis=0)
    far = np.flatnonzero(~np.isfinite(below[-1]))
    if len(far):
        tables = np.arange(size)
        grow = np.cumsum(np.log((STRENGTH + d * (others[far][:, None] + tables)) * p[far][:, None]), axis=1)
        weight = logs[1 : size + 1] + grow
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        t[far] = 1 + (weight < uniform[far][:, None] * weight[:, -1:]).sum(axis=1)
    return t


def _draw_large(c, others, p, d, uniform) -> np.ndarray:
    """Tables of dishes with many customers. For c much larger than t,
    S_d(c, t) ~ F^(t - 1) / (t - 1)! with F = (1 - (e^gamma c)^-d) / d, so t - 1 is
    negative binomial. Where tables are nearly as many as customers, the
    expected number under seating one customer after the other is smaller and
    bounds it."""
    size = (STRENGTH + d * others) / d + 1
    z = p * -np.expm1(-d * (np.euler_gamma + np.log(c)))
    mean = size * z / (1 - z)
    more = np.zeros(len(c), np.int64)
    # Small means by inversion, others by the normal limit.
    few = np.flatnonzero(mean < 100)
    term = np.exp(size[few] * np.log1p(-z[few]))
    below, k = term.copy(), 0
    while len(few):
        on = below < uniform[few]
        more[few[on]] += 1
        few, term, below = few[on], term[on], below[on]
        term = term * (size[few] + k) * z[few] / (k + 1)
        below, k = below + term, k + 1
        stuck = term < 1e-18 * np.maximum(below, 1e-300)
        if stuck.any():
            few, term, below = few[~stuck], term[~stuck], below[~stuck]
    many = np.flatnonzero(mean >= 100)
    second = (_mix((uniform[many] * 2.0**53).astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    normal = np.sqrt(-2 * np.log(np.maximum(uniform[many], 2.0**-53))) * np.cos(2 * np.pi * second)
    more[many] = np.rint(mean[many] + np.sqrt(mean[many] / (1 - z[many])) * normal).astype(np.int64)
    # Blocks of a 32nd of the customers seated so far.
    seated, t, live = np.ones(len(c)), np.ones(len(c)), np.arange(len(c))
    while len(live):
        m = np.minimum(np.maximum(1.0, np.floor(seated[live] / 32)), c[live] - seated[live])
        new = (STRENGTH + d * (others[live] + t[live])) * p[live]
        t[live] += m * new / (new + seated[live] - d * t[live])
        seated[live] += m
        live = live[seated[live] < c[live]]
    bound = np.maximum(np.floor(t + uniform), 1).astype(np.int64)
    near = t > 0.2 * c
    return np.where(near, np.minimum(1 + more, bound), 1 + more)


class Model:
    """The numbers shared by all tasks: discounts, sizes, and the totals of
    the word restaurant in each kept sample."""

    def __init__(self, n: int, pairs: int, d2: float):
        self.n, self.pairs, self.d2 = n, pairs, d2
        self.v, self.d1 = 0, 0.5
        self.customers: list[int] = []
        self.tables: list[int] = []

    @property
    def base(self) -> float:
        return 1.0 / (self.v + 1)

    def before(self, customers: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers in a
        sweep's draws: its tables' discounts go back to words alike."""
        return np.maximum(customers, 1) / (STRENGTH + self.pairs)

    def word_tables(self, sample: int, w: np.ndarray, customers: np.ndarray) -> np.ndarray:
        n = len(w)
        return draw_tables(customers, np.full(n, max(self.v - 1, 0)), np.full(n, self.base), self.d1,
                           _uniform(1000 + sample, w, w))

    def word(self, sample: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """P(w) in the word restaurant."""
        rest = (STRENGTH + self.d1 * self.tables[sample]) * self.base
        return (customers - self.d1 * tables + rest) / (STRENGTH + self.customers[sample])

    def pair_tables(self, sweep: int, u, w, c, context_dishes, customers) -> np.ndarray:
        """The seats of context dishes in a sweep."""
        return draw_tables(c, np.maximum(context_dishes - 1, 0), self.before(customers), self.d2, _uniform(sweep, u, w))


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


# ---------------------------------------------------------------- batches

def _batches(batches: Iterator, size: int) -> Iterator:
    """Documents as numbers: ``batch, ids, held, sizes, tokens, words`` with
    the batch's word hashes; its training tokens, and the words that hold at least
    1 / HEAVY of them, with counts."""
    import pyarrow as pa
    import xxhash
    import zstandard
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId() << 32, 0
    pack = zstandard.ZstdCompressor(level=3)

    def flush(kind, ids, held, docs, number):
        nonlocal seq
        sizes = np.array([len(x) for x in docs], np.int64)
        tokens = np.concatenate(docs)
        learn = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(tokens[learn], minlength=len(number)).astype(np.int64)
        often = np.flatnonzero((counts * HEAVY >= learn.sum()) & (counts > 0))
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64).view(np.int64)
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([part + seq], pa.int64()),
                pa.array([ids], pa.list_(kind)),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([pack.compress(tokens.astype(np.int32).tobytes())], pa.binary()),
                pa.array([words], pa.list_(pa.int64())),
                pa.array([int(learn.sum())], pa.int64()),
                pa.array([words[often]], pa.list_(pa.int64())),
                pa.array([counts[often]], pa.list_(pa.int64())),
            ],
            ["batch", "ids", "held", "sizes", "tokens", "words", "learned", "often", "times"],
        )
        seq += 1
        return row

    def fresh():
        number = defaultdict()
        number.default_factory = number.__len__
        number[_END], number[_START]
        return number

    for b in batches:
        kind = b.column("doc_id").type
        ids, held, docs, total, number = [], [], [], 0, fresh()
        for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text")):
            t = t.as_py()
            words = t.encode().lower().split() if t else []
            docs.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            docs[-1] = np.append(docs[-1], 0)
            ids.append(d)
            held.append(h)
            total += len(words) + 1
            if total >= size:
                yield flush(kind, ids, held, docs, number)
                ids, held, docs, total, number = [], [], [], 0, fresh()
        if docs:
            yield flush(kind, ids, held, docs, number)


class Pairs:
    """The distinct (previous word, word) pairs of a batch, in a fixed order."""

    def __init__(self, sizes, held, tokens, words):
        import zstandard

        self.tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens), np.int32).astype(np.int64)
        self.words = np.asarray(words, np.int64)
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        previous = np.empty_like(self.tokens)
        previous[1:] = self.tokens[:-1]
        previous[self.starts] = 1
        learn = np.repeat(~np.asarray(held, bool), self.sizes)
        previous *= len(self.words)
        previous += self.tokens
        key, self.of_token = np.unique(previous, return_inverse=True)
        del previous
        self.counts = np.bincount(self.of_token, weights=learn, minlength=len(key)).astype(np.int64)
        self.left, self.right = key // len(self.words), key % len(self.words)

    def buckets(self, n: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the pairs by bucket, the buckets present and where each
        one's pairs begin in that order."""
        h = _mix(self.words)
        spread = np.flatnonzero(np.isin(self.words, heavy)[self.left])
        of = h[self.left]
        of[spread] = _mix(of[spread] + h[self.right[spread]])
        of = (of % np.uint64(n)).astype(np.int64)
        order = np.argsort(of.astype(np.uint16) if n <= 1 << 16 else of, kind="stable")
        which, first = np.unique(of[order], return_index=True)
        return order, which, first


def _bucket(key: np.ndarray, other: np.ndarray, n: int, heavy: np.ndarray) -> np.ndarray:
    h = _mix(key)
    spread = np.isin(key, heavy)
    h = np.where(spread, _mix(h + _mix(other)), h)
    return (h % np.uint64(n)).astype(np.int64)


# Numbers travel packed (``_pack``). ``n``: what a part adds to the corpus' sums.
_PARTS = "kind int, batch bigint, bucket int, a binary, b binary, c binary, d binary, n bigint"
_SENT = "kind int, batch bigint, bucket int, a binary, b binary, c binary, d binary, e binary"
_ANSWER, _CONTEXT, _DISH, _SINGLE, _SPREAD, _OFTEN = range(6)


def _frame(rows: list):
    import pandas as pd

    return pd.DataFrame(rows, columns=["kind", "batch", "bucket", "a", "b", "c", "d", "n"])


_WIDTHS = [np.int8, np.int16, np.int32, np.int64]


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them all, told by the
    first byte."""
    lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    k = next(k for k, t in enumerate(_WIDTHS) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
    return bytes([k]) + x.astype(_WIDTHS[k]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _WIDTHS[packed[0]], offset=1).astype(np.int64)


def _unpacked(column) -> np.ndarray:
    """All numbers of a column of packed ones."""
    return np.concatenate([np.empty(0, np.int64), *map(_unpack, column)])


def _send(batches: Iterator, n: int, heavy: np.ndarray) -> Iterator:
    """A batch's pairs by bucket: contexts ``a`` with ``b`` pairs each, the
    distinct words ``c``, the pairs' training counts ``d`` and words ``e``, by
    place among the distinct ones."""
    import pyarrow as pa

    for b in batches:
        for i in range(b.num_rows):
            sizes, held, words = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("sizes", "held", "words"))
            pairs = Pairs(sizes, held, b.column("tokens")[i].as_py(), words)
            order, which, first = pairs.buckets(n, heavy)
            u, w, c = pairs.left[order], pairs.right[order], pairs.counts[order]
            out = []
            for k, lo, hi in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                new = np.flatnonzero(np.append(True, u[lo + 1 : hi] != u[lo : hi - 1]))
                words, place = np.unique(w[lo:hi], return_inverse=True)
                out.append((k, _pack(pairs.words[u[lo:hi][new]]), _pack(np.diff(np.append(new, hi - lo))), _pack(pairs.words[words]),
                            _pack(c[lo:hi]), _pack(place)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(out), pa.int32()), pa.array([b.column("batch")[i].as_py()] * len(out), pa.int64()),
                 pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3, 4, 5)]],
                ["kind", "batch", "bucket", "a", "b", "c", "d", "e"],
            )


def _count(frame, n: int, heavy: np.ndarray):
    """Adds up a bucket's pairs: the answer to every batch; contexts with
    their dishes and customers; dishes of two or more customers and the number
    of single ones by word bucket, those of spread words apart; dishes of spread
    words."""
    frame = frame.sort_values("batch")
    parts = [_unpack(x) for x in frame["d"]]
    lengths, got = [len(x) for x in parts], np.concatenate(parts)
    u = np.repeat(_unpacked(frame["a"]), _unpacked(frame["b"]))
    w = np.concatenate([_unpack(c)[_unpack(e)] for c, e in zip(frame["c"], frame["e"])])
    order = np.lexsort((w, u))
    new = np.append(True, (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1]))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    pu, pw = u[order][new], w[order][new]
    c = np.bincount(which, weights=got).astype(np.int64)
    out = []
    answers = np.split(c[which], np.cumsum(lengths)[:-1])
    bucket = int(frame["bucket"].iloc[0])
    for batch, a in zip(frame["batch"].tolist(), answers):
        out.append((_ANSWER, batch, bucket, None, None, _pack(a), None, 0))
    pu, pw, c = pu[c > 0], pw[c > 0], c[c > 0]
    if len(c):
        first = np.flatnonzero(np.append(True, pu[1:] != pu[:-1]))
        dishes = np.diff(np.append(first, len(pu)))
        out.append((_CONTEXT, 0, 0, _pack(pu[first]), _pack(dishes), _pack(np.add.reduceat(c, first)), None, len(c)))
        around = np.repeat(dishes, dishes)
        to = _bucket(pw, pu, n, heavy)
        often = np.isin(pw, heavy)
        for at, kind in ((~often & (c > 1), _DISH), (often & (c > 1), _OFTEN), (c == 1, _SINGLE)):
            at = np.flatnonzero(at)
            at = at[np.argsort(to[at], kind="stable")]
            ks, starts = np.unique(to[at], return_index=True)
            for k, part in zip(ks.tolist(), np.split(at, starts[1:])):
                if kind != _SINGLE:
                    twice = int(np.count_nonzero(c[part] == 2))
                    out.append((kind, 0, k, _pack(pu[part]), _pack(pw[part]), _pack(c[part]), _pack(around[part]), twice))
                else:
                    words, times = np.unique(pw[part], return_counts=True)
                    out.append((_SINGLE, 0, k, _pack(words), None, _pack(times), None, len(part)))
        words, times = np.unique(pw[often], return_counts=True)
        if len(words):
            out.append((_SPREAD, 0, 0, _pack(words), None, _pack(times), None, 0))
    return _frame(out)


def _around(u, around, heavy: np.ndarray, heavy_context: np.ndarray) -> np.ndarray:
    """Dishes of the contexts; of spread ones over all buckets."""
    spread = np.isin(u, heavy)
    if spread.any():
        around[spread] = heavy_context[np.searchsorted(heavy, u[spread])]
    return around


def _sweep_spread(batches: Iterator, sweep: int, model: Model, heavy: np.ndarray, heavy_context: np.ndarray,
                  given: np.ndarray) -> Iterator:
    """Tables beyond one a dish of the spread words in a sweep, whose draws
    go by ``given`` customers."""
    import pyarrow as pa

    more = np.zeros(len(heavy), np.int64)
    for b in batches:
        u, w, c, around = (_unpacked(b.column(k).to_pylist()) for k in "abcd")
        at = np.searchsorted(heavy, w)
        t = model.pair_tables(sweep, u, w, c, _around(u, around, heavy, heavy_context), given[at])
        more += np.bincount(at, weights=t - 1, minlength=len(heavy)).astype(np.int64)
    some = np.flatnonzero(more)
    yield pa.RecordBatch.from_arrays([pa.array(heavy[some]), pa.array(more[some])], ["key", "n"])


def _seat(frame, model: Model, heavy: np.ndarray, heavy_context: np.ndarray, heavy_given: np.ndarray):
    """The sweeps over a word bucket. A row a word: its tokens and its
    customers before the first kept sweep and after each. A row a context: its
    tables beyond one a dish, in each kept sweep. ``heavy_given`` holds, by sweep,
    the customers of the spread words over all buckets."""
    import pandas as pd

    dish, one = frame[frame["kind"].isin([_DISH, _OFTEN])], frame[frame["kind"] == _SINGLE]

    u, w, c, around = (_unpacked(dish[k]) for k in "abcd")
    single, times = _unpacked(one["a"]), _unpacked(one["c"])
    words, at = np.unique(np.concatenate([w, single]), return_inverse=True)
    at, ones = at[: len(w)], np.bincount(at[len(w) :], weights=times, minlength=len(words)).astype(np.int64)
    tokens = ones + np.bincount(at, weights=c, minlength=len(words)).astype(np.int64)
    around = _around(u, around, heavy, heavy_context)
    customers = ones + np.bincount(at, minlength=len(words))
    contexts, of = np.unique(u, return_inverse=True)
    steps, extra = [], []
    for sweep in range(BURN + SAMPLES):
        if sweep == BURN:
            steps.append(customers)
        t = model.pair_tables(sweep, u, w, c, around, _given(words, customers, heavy, heavy_given[sweep])[at])
        customers = ones + np.bincount(at, weights=t, minlength=len(words)).astype(np.int64)
        if sweep >= BURN:
            steps.append(customers)
            extra.append(np.bincount(of, weights=t - 1, minlength=len(contexts)).astype(np.int64))
    some = np.flatnonzero(np.any(extra, axis=0))
    rows = {k: np.zeros(len(words) + len(some), np.int64) for k in SEATS}
    rows["key"][:] = np.concatenate([words, contexts[some]])
    rows["cw"][: len(words)] = tokens
    for s, x in enumerate(steps):
        rows[f"step{s}"][: len(words)] = x
    for s, x in enumerate(extra):
        rows[f"extra{s}"][len(words) :] = x[some]
    return pd.DataFrame(rows)


def _given(words, customers, heavy, everywhere) -> np.ndarray:
    """Customers that a sweep goes by: of spread words, those of all buckets."""
    given, spread = customers.copy(), np.isin(words, heavy)
    if spread.any():
        given[spread] = everywhere[np.searchsorted(heavy, words[spread])]
    return given


STEPS = SAMPLES + 1
SEATS = ["key", "cw", *[f"step{s}" for s in range(STEPS)], *[f"extra{s}" for s in range(SAMPLES)]]
WORD = ["cw", "cu", "du", *[f"step{s}" for s in range(STEPS)], *[f"extra{s}" for s in range(SAMPLES)]]


def _table_sums(batches: Iterator, model: Model) -> Iterator:
    """Tables of the word restaurant, summed."""
    import pyarrow as pa

    for b in batches:
        w = b.column("key").to_numpy(zero_copy_only=False)
        steps = np.cumsum([b.column(k).to_numpy(zero_copy_only=False) for k in ["cw", *[f"step{s}" for s in range(STEPS)]]], axis=0)
        t = [model.word_tables(s, w, steps[s + 2]).sum() for s in range(SAMPLES)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in t], [f"t{s}" for s in range(SAMPLES)])


_GATHERED = "to bigint, bucket int, pos binary, c binary"


def _gather(batches: Iterator) -> Iterator:
    """Word rows that go to one batch, packed: their places and all their
    numbers (``c``, one column of ``WORD`` after the other)."""
    import pyarrow as pa

    for b in batches:
        to = b.column("to").to_numpy(zero_copy_only=False)
        order = np.argsort(to, kind="stable")
        which, first = np.unique(to[order], return_index=True)
        pos = np.split(b.column("pos").to_numpy(zero_copy_only=False)[order], first[1:])
        numbers = np.split(np.stack([b.column(k).to_numpy(zero_copy_only=False)[order] for k in WORD]), first[1:], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int64()), pa.array([-1] * len(which), pa.int32()), pa.array(map(_pack, pos), pa.binary()),
             pa.array([_pack(x.ravel()) for x in numbers], pa.binary())],
            ["to", "bucket", "pos", "c"],
        )


def _score(batch, numbers, model: Model, n: int, heavy: np.ndarray, columns: list[str]):
    """Scores of one batch's documents. ``numbers`` holds the buckets'
    answers (``bucket`` >= 0) and the numbers of the batch's words."""
    import pandas as pd

    out = []
    if not len(batch):
        return pd.DataFrame([], columns=columns)
    row = batch.iloc[0]
    pairs = Pairs(row["sizes"], row["held"], row["tokens"], row["words"])
    order, which, _ = pairs.buckets(n, heavy)
    answers = numbers[numbers["bucket"] >= 0].sort_values("bucket")
    c = np.empty(len(order), np.int64)
    c[order] = _unpacked(answers["c"])
    by_word = numbers[numbers["bucket"] < 0]
    word = {k: np.zeros(len(pairs.words), np.int64) for k in WORD}
    for pos, got in zip(by_word["pos"], by_word["c"]):
        at = _unpack(pos)
        for k, x in zip(WORD, _unpack(got).reshape(len(WORD), -1)):
            word[k][at] = x
    word["cu"] += word["cw"]
    word["du"] += word["cu"]
    word["step0"] += word["cw"]
    for s in range(1, STEPS):
        word[f"step{s}"] += word[f"step{s - 1}"]
    u, w = pairs.left, pairs.right
    p = np.zeros(len(c))
    # Dishes of one customer have one table; the others are drawn.
    some = np.flatnonzero(c > 1)
    un, wn = pairs.words[u[some]], pairs.words[w[some]]
    for s in range(SAMPLES):
        after = word[f"step{s + 1}"]
        parent = model.word(s, after, model.word_tables(s, pairs.words, after))[w]
        t = np.minimum(c, 1)
        t[some] = model.pair_tables(BURN + s, un, wn, c[some], word["du"][u[some]], word[f"step{s}"][w[some]])
        rest = (STRENGTH + model.d2 * (word["du"] + word[f"extra{s}"]))[u]
        p += (c - model.d2 * t + rest * parent) / (STRENGTH + word["cu"])[u]
    log = np.log10(p / SAMPLES)[pairs.of_token]
    seen = word["cw"][pairs.tokens]
    base = np.log10((word["cw"] + 1) / (model.n + model.v + 1))[pairs.tokens]
    out = {
        columns[0]: list(row["ids"]), "held_out": list(row["held"]), "n_tokens": pairs.sizes,
        "n_known": np.add.reduceat((seen > 0).astype(np.int64), pairs.starts),
        "base_score": np.add.reduceat(base, pairs.starts), "score": np.add.reduceat(log, pairs.starts),
    }
    return pd.DataFrame(out, columns=columns)


def held_out() -> F.Column:
    """True where crc32 of the id, as text, leaves 2 modulo 7; false for a
    null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _exploded(parts: DataFrame, columns: str, *names: str) -> DataFrame:
    """One row per element of the array columns named by letter."""
    z = F.explode(F.arrays_zip(*[F.col(c) for c in columns])).alias("z")
    return parts.select(z).select(*[F.col(f"z.{c}").alias(n) for c, n in zip(columns, names)])


def _unpacked_rows(parts: DataFrame, columns: str, *names: str) -> DataFrame:
    """One row per number of the packed columns named by letter."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(b.column(c).to_pylist())) for c in columns], list(names))

    return parts.select(*columns).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    d = docs.select("doc_id", held_out().alias("held"), "text")
    id_type = d.schema["doc_id"].dataType
    size = BATCH
    streams = scratch.keep(
        d.mapInArrow(
            lambda it: _batches(it, size),
            f"batch bigint, ids array<{id_type.simpleString()}>, held array<boolean>, sizes array<bigint>, tokens binary, "
            "words array<bigint>, learned bigint, often array<bigint>, times array<bigint>",
        ), "streams"
    )
    n_train = int(streams.agg(F.sum("learned").alias("n")).first()["n"] or 0)
    # A word with twice 1 / HEAVY of all tokens is among them: where it holds less
    # than 1 / HEAVY of a batch, these parts add up to less than 1 / HEAVY of all.
    frequent = _exploded(streams, ["often", "times"], "key", "n").groupBy("key").agg(F.sum("n").alias("n"))
    spread = scratch.keep(frequent.where(F.col("n") >= max(n_train // HEAVY + 1, SPREAD_LEAST)).select("key"), "spread")
    heavy = np.array(sorted(r["key"] for r in spread.collect()), np.int64)
    n_buckets = max(1, -(-max(n_train, 1) // BUCKET))
    sent = streams.select("batch", "sizes", "held", "tokens", "words").mapInArrow(lambda it: _send(it, n_buckets, heavy), _SENT)
    parts = scratch.keep(
        sent.groupBy("bucket").applyInPandas(lambda f: _count(f, n_buckets, heavy), _PARTS), "parts", partition_by="kind"
    )
    contexts = _unpacked_rows(parts.where(F.col("kind") == _CONTEXT), "abc", "key", "du", "cu")
    dishes = [_DISH, _OFTEN, _SINGLE]
    sums = parts.agg(
        F.sum(F.when(F.col("kind") == _CONTEXT, F.col("n"))).alias("pairs"),
        F.sum(F.when(F.col("kind") == _SINGLE, F.col("n"))).alias("once"),
        F.sum(F.when(F.col("kind").isin(_DISH, _OFTEN), F.col("n"))).alias("twice"),
    ).first()
    model = Model(n_train, int(sums["pairs"] or 0), discount(int(sums["once"] or 0), int(sums["twice"] or 0)))
    # Dishes of the spread words, as contexts and as words (at most HEAVY rows).
    of_context = dict(contexts.join(spread, "key").groupBy("key").agg(F.sum("du").alias("n")).collect())
    spread_dishes = _unpacked_rows(parts.where(F.col("kind") == _SPREAD), "ac", "key", "n").groupBy("key").agg(F.sum("n").alias("n"))
    of_word = dict(spread_dishes.collect())
    heavy_context = np.array([of_context.get(k, 0) for k in heavy.tolist()], np.int64)
    heavy_word = np.array([of_word.get(k, 0) for k in heavy.tolist()], np.int64)
    heavy_given = _spread_customers(parts, model, heavy, heavy_context, heavy_word)
    seats = scratch.keep(
        parts.where(F.col("kind").isin(dishes)).groupBy("bucket").applyInPandas(
            lambda f: _seat(f, model, heavy, heavy_context, heavy_given), ", ".join(f"{k} bigint" for k in SEATS)), "seats"
    )
    each = scratch.keep(_word_numbers(contexts, seats), "numbers")
    for kind in (_CONTEXT, *dishes, _SPREAD):
        scratch.drop("parts", f"kind={kind}")
    scratch.drop("seats")
    answers = parts.where(F.col("kind") == _ANSWER).select(F.col("batch").alias("to"), "bucket", "c")
    total = each.agg(
        F.sum((F.col("cw") > 0).cast("long")).alias("v"), F.sum((F.col("cw") == 1).cast("long")).alias("once"),
        F.sum((F.col("cw") == 2).cast("long")).alias("twice"), F.sum("step0").alias("c0"), *[F.sum(f"step{s}").alias(f"c{s}") for s in range(1, STEPS)],
    ).first()
    model.v, model.d1 = int(total["v"] or 0), discount(int(total["once"] or 0), int(total["twice"] or 0))
    customers = n_train + np.cumsum([int(total[f"c{s}"] or 0) for s in range(STEPS)])
    model.customers = customers[1:].tolist()
    tables = each.mapInArrow(lambda it: _table_sums(it, model), ", ".join(f"t{s} bigint" for s in range(SAMPLES)))
    tables = tables.agg(*[F.sum(f"t{s}").alias(f"t{s}") for s in range(SAMPLES)]).first()
    model.tables = [int(tables[f"t{s}"] or 0) for s in range(SAMPLES)]
    asked = streams.select(F.col("batch").alias("to"), F.posexplode("words").alias("pos", "key")).join(each, "key").drop("key")
    asked = scratch.keep(asked.select("to", "pos", *WORD).mapInArrow(_gather, _GATHERED), "asked")
    scratch.drop("numbers")
    numbers = asked.unionByName(answers.withColumn("pos", F.lit(None).cast("binary")))
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    columns = schema.names
    batches = streams.select("batch", "ids", "held", "sizes", "tokens", "words").groupBy("batch")
    scored = batches.cogroup(numbers.groupBy("to")).applyInPandas(
        lambda b, k: _score(b, k, model, n_buckets, heavy, columns), schema
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _spread_customers(parts: DataFrame, model: Model, heavy: np.ndarray, heavy_context: np.ndarray,
                      heavy_word: np.ndarray) -> np.ndarray:
    """The customers of the spread words that each sweep goes by: one a dish
    at first, then those after the sweep before (at most HEAVY numbers a sweep)."""
    given = np.tile(heavy_word, (BURN + SAMPLES, 1))
    often = parts.where(F.col("kind") == _OFTEN).select("a", "b", "c", "d")
    for sweep in range(BURN + SAMPLES - 1 if len(heavy) else 0):
        before = given[sweep]
        more = often.mapInArrow(
            lambda it, s=sweep, g=before: _sweep_spread(it, s, model, heavy, heavy_context, g), "key bigint, n bigint"
        )
        for key, n in more.groupBy("key").agg(F.sum("n").alias("n")).collect():
            given[sweep + 1, np.searchsorted(heavy, key)] += n
    return given


def _word_numbers(contexts: DataFrame, seats: DataFrame) -> DataFrame:
    """One row a word with the columns ``WORD``; tokens as context and dishes
    as context are differences to the column before, customers to the tokens or to
    the customers before."""

    def rows(df: DataFrame) -> DataFrame:
        return df.select("key", *[F.col(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in WORD])

    n = rows(seats).unionByName(rows(contexts)).groupBy("key").agg(*[F.sum(c).alias(c) for c in WORD])
    # Mostly zero once kept as differences, which compress well.
    step = [(F.col(f"step{s}") - F.col(f"step{s - 1}")).alias(f"step{s}") for s in range(1, STEPS)]
    return n.select("key", "cw", (F.col("cu") - F.col("cw")).alias("cu"), (F.col("du") - F.col("cu")).alias("du"),
                    (F.col("step0") - F.col("cw")).alias("step0"), *step, *[f"extra{s}" for s in range(SAMPLES)])


def op11_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
