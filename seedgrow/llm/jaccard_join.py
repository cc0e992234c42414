"""Exact Jaccard join of documents over five-word shingles.

Distance 1 - J is a metric, so pivots and the triangle inequality apply; two
documents link when 1 - J <= EPS = 0.25, tested on integers.

1. Documents with equal shingle sets are one class; only classes are joined.
2. Every class emits the shingles that a partner must share one of: the first
   n - ceil(0.75 n) + 1 of its set in an order that puts shingles repeated
   across documents last (any fixed order is exact; this one keeps common
   passages out of the keys). Classes that share such a shingle, cut into runs
   of compatible sizes, fall to one pivot, the run's first class. The regions
   of all pivots together hold every linked pair.
3. Every class is compared with one pivot: of those that may link by their
   sketches (see ``sketch``), the one of its largest region. Where these
   links lead to is a class's root; pairs of one root need no comparison.
4. Regions with members of several roots are left. A member stays where some
   member of another root may link to it by their sketches, and only the sets
   of those that stay are sent. In a region all distances to a pivot are
   computed, and only pairs of different roots whose distances to the pivot
   differ by at most EPS are compared.
5. A region that holds more than one task should take is split by further
   pivots. Members linked to a pivot take its root; the outsiders are those not
   of the region's commonest root, and every pair to compare has one. An
   outsider goes to its nearest pivot's cell; a member is replicated into every
   cell whose farthest outsider is at most EPS nearer to the pivot than it is
   (and which is within 2 EPS of its own), so that each linked pair meets; the
   cells are treated like regions, recursively. A region whose cells would
   take no fewer rows than its own pairs of blocks (members that are all about
   as far from one another fall into every cell), or that is still too large
   after ``LEVELS`` rounds, is joined exactly in pairs of blocks, where again
   only the sets of those members are sent that may link by their sketches.
6. Components of the links give each document its class.

Scale: the corpus is read for the classes and the prefixes, then for the sets
of the classes that may link to a pivot, and once more for those of step 4.
The prefixes, a quarter of the shingles, are shuffled once; texts are never
shuffled. Copies collapse before the shuffle (per task) and again by class.
Broadcast: one array of ``BUCKETS`` counts and at most ``ID_BUCKETS`` bucket
numbers, both of fixed size. Everything gathered in one task is bounded by
``REGION_SHINGLES`` and ``REGION_ROWS``; the classes of one pivot are dealt
over as many tasks as they need.

Shingles and sets are told apart by 64-bit hashes.

Edge cases: null and empty texts (no words) have an empty set, link with
nothing and are their own component; with fewer than five words the whole
sequence is the one shingle; repeated rows are one class; a null id has
component null unless its component holds an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedgrow.llm.common import Scratch, read_table
from seedgrow.llm.components import components

# Words of a shingle and the threshold in percent.
WORDS = 5
PERCENT = 75
EPS = 1 - PERCENT / 100
# Buckets of the repetition counts, and what one task may hold of a region.
BUCKETS = 1 << 18
REGION_ROWS = 2000
REGION_SHINGLES = 2_000_000
PIVOTS = 8
LEVELS = 3
# Buckets of ids that are broadcast.
ID_BUCKETS = 1 << 20
# Rows handled at once inside an Arrow batch; shingles per counting window;
# entries of the per-task memories.
ROWS = 64
WINDOW = 2_000_000
MEMO = 500_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# Bytes that end a word.
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: the sum of a mixed value
    of each byte and its place in the word. No word is kept as an object."""
    x = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(~_BLANK[x])
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.append(True, np.diff(at) != 1))
    place = at - np.repeat(at[first], np.diff(np.append(first, len(at))))
    v = (place.astype(np.uint64) << np.uint64(8) | x[at]) + _MULTIPLIER
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.add.reduceat(v ^ (v >> np.uint64(31)), first)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = _word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(WORDS, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = (acc ^ h[k : k + len(acc)]) * _MULTIPLIER
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def class_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set (and its size)."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s) & 0xFFFFFFFF)
    return h - (1 << 64) if h >= 1 << 63 else h


def sketch(s: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of B equal ranges, in two bits
    (3: three or more); B is the power of two above the set's size.

    Two sets share at most the sum of the lesser counts, plus the lesser of
    what the two sets hold beyond their counts: an upper bound that never
    rejects a linked pair, at about a twentieth of a set's size."""
    bits = max(6, len(s).bit_length())
    c = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 3)
    return (c.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8).tobytes()


def _counts(packed: bytes, size: int | None = None) -> np.ndarray:
    """The counts of a sketch over ``size`` ranges (its own, or fewer)."""
    c = ((np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()
    if size is not None and size < len(c):
        c = np.minimum(c.reshape(size, -1).sum(1), 3).astype(np.uint8)
    return c


def _may_link(m: np.ndarray, n: np.ndarray, over: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Which rows of counts ``m`` (sizes ``n``, rest ``over``) may link to a set
    of size ``k`` with counts ``c``."""
    most = np.minimum(m, c).sum(1, dtype=np.int64) + np.minimum(over, k - int(c.sum(dtype=np.int64)))
    return 100 * most >= PERCENT * (n + k - most)


def _texts(batch) -> Iterator[tuple[int, str | None]]:
    for k in range(0, batch.num_rows, ROWS):
        yield from enumerate(batch.column("text").slice(k, ROWS).to_pylist(), k)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) % BUCKETS


def _classify(batches: Iterator) -> Iterator:
    """Class rows of a task's documents, and repetition counts by bucket."""
    import pyarrow as pa

    seen: set[int] = set()
    window: list[np.ndarray] = []
    held = 0
    total = np.zeros(BUCKETS, np.int64)

    def count():
        if window:
            x = np.concatenate(window)
            window.clear()
            x.sort()
            same = x[1:] == x[:-1]
            # Shingles that come twice or more, as often as they come.
            again = np.append(False, same) | np.append(same, False)
            np.add.at(total, _bucket(x[again]), 1)

    for b in batches:
        sizes = np.zeros(b.num_rows, np.int32)
        sigs: list[int | None] = [None] * b.num_rows
        sketches: list[bytes | None] = [None] * b.num_rows
        for i, t in _texts(b):
            s = shingle_set(t)
            if len(s):
                sizes[i], sigs[i] = len(s), class_hash(s)
                if sigs[i] not in seen:
                    if len(seen) >= MEMO:
                        seen.clear()
                    seen.add(sigs[i])
                    sketches[i] = sketch(s)
                    window.append(s)
                    held += len(s)
                    if held >= WINDOW:
                        count()
                        held = 0
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes), pa.array(sigs, pa.int64()), pa.array(sketches, pa.binary()),
             none.cast(pa.int32()), none],
            ["doc_id", "n", "sig", "sketch", "bucket", "repeats"],
        )
    count()
    at = np.flatnonzero(total)
    none = pa.nulls(len(at), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, pa.array(np.zeros(len(at), np.int32)), none, pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)),
         pa.array(total[at])],
        ["doc_id", "n", "sig", "sketch", "bucket", "repeats"],
    )


def _prefixes(repeats: dict[int, int]):
    """Map function: the prefix shingles of each class, once per task."""
    at = np.array(sorted(repeats), np.int64)
    values = np.array([repeats[i] for i in at], np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        order = np.zeros(BUCKETS, np.int64)
        order[at] = values
        seen: set[int] = set()
        for b in batches:
            parts, sizes, sigs = [], [], []
            for _, t in _texts(b):
                s = shingle_set(t)
                n = len(s)
                if not n or (sig := class_hash(s)) in seen:
                    continue
                if len(seen) >= MEMO:
                    seen.clear()
                seen.add(sig)
                first = n - -(-PERCENT * n // 100) + 1
                parts.append(s[np.lexsort((s, order[_bucket(s)]))[:first]])
                sizes.append(n)
                sigs.append(sig)
            if parts:
                lengths = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(parts).view(np.int64)),
                        pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        pa.array(np.repeat(np.array(sigs, np.int64), lengths)),
                    ],
                    ["s", "n", "sig"],
                )

    return run


def _sets(batches: Iterator) -> Iterator:
    """The set of each class, once per task."""
    import pyarrow as pa

    seen: set[int] = set()
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            sets, sigs = [], []
            for t in b.column("text").slice(k, ROWS).to_pylist():
                s = shingle_set(t)
                if len(s) and (sig := class_hash(s)) not in seen:
                    if len(seen) >= MEMO:
                        seen.clear()
                    seen.add(sig)
                    sets.append(s)
                    sigs.append(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sigs, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["sig", "n", "items"],
            )


def _lists(column) -> list[np.ndarray]:
    """The sets of an Arrow column, without copying."""
    values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:])]


def _regions(batches: Iterator) -> Iterator[dict]:
    """The columns of each region of rows that come sorted by region."""
    held, current = [], None

    def joined():
        out = {}
        for name in held[0].schema.names:
            parts = [b.column(name) for b in held]
            if name == "items":
                out[name] = [x for p in parts for x in _lists(p)]
            elif name == "sketch":
                out[name] = [x for p in parts for x in p.to_pylist()]
            else:
                out[name] = np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts])
        return out

    for b in batches:
        if not b.num_rows:
            continue
        r = b.column("region").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and r[i] != current:
                yield joined()
                held = []
            held.append(b.slice(i, j - i))
            current = r[i]
    if held:
        yield joined()


def _by_region(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the batches of rows that are dealt and sorted by region."""
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(fn, schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Shared elements of two sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def _pairs_that_may_link(batches: Iterator) -> Iterator:
    """Of the pairs of a class and a pivot those that may link."""
    import pyarrow as pa

    for b in batches:
        n, pn = b.column("n").to_numpy(), b.column("pn").to_numpy()
        may = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column("sketch").to_pylist(), b.column("psketch").to_pylist())):
            size = 4 * min(len(x), len(y))
            c = _counts(x, size)[None]
            k = n[i : i + 1].astype(np.int64)
            may[i] = _may_link(c, k, k - c.sum(dtype=np.int64), _counts(y, size), int(pn[i]))[0]
        yield b.select(["region", "sig"]).filter(pa.array(may))


def _to_pivot(batches: Iterator) -> Iterator:
    """Links of classes to the pivot that comes before them."""
    import pyarrow as pa

    pivot = np.empty(0, np.uint64)
    for b in batches:
        is_pivot, sig = b.column("is_pivot").to_pylist(), b.column("sig").to_numpy()
        linked = np.zeros(b.num_rows, bool)
        for i, s in enumerate(_lists(b.column("items"))):
            if is_pivot[i]:
                pivot = s.copy()
            else:
                common = _common(s, pivot)
                linked[i] = 100 * common >= PERCENT * (len(s) + len(pivot) - common)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sig[linked]), pa.array(b.column("region").to_numpy()[linked])], ["a", "b"]
        )


def _outsiders(root: np.ndarray) -> np.ndarray:
    """Members not of the commonest root; every pair to compare has one."""
    roots, n = np.unique(root, return_counts=True)
    return root != roots[np.argmax(n)]


def _survivors(batches: Iterator) -> Iterator:
    """Members of each region that may link to a member of another root."""
    import pyarrow as pa

    for r in _regions(batches):
        n, root = r["n"].astype(np.int64), r["root"]
        outside = np.flatnonzero(_outsiders(root))
        size = 4 * min(map(len, r["sketch"]))
        m = np.stack([_counts(x, size) for x in r["sketch"]])
        over = n - m.sum(1, dtype=np.int64)
        stays = np.zeros(len(n), bool)
        for i in outside:
            near = _may_link(m, n, over, m[i], int(n[i])) & (root != root[i])
            if near.any():
                stays |= near
                stays[i] = True
        if stays.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[c][stays]) for c in ("region", "sig", "root")], ["region", "sig", "root"]
            )


def _join_region(batches: Iterator) -> Iterator:
    """Links inside each region between members of different roots, exactly.

    ``d`` is the distance to the region's pivot where it is known already; else
    the first member by size is the pivot. Emits a spanning forest.
    """
    import pyarrow as pa

    for r in _regions(batches):
        order = np.lexsort((r["sig"], r["n"]))
        n, sig, root = r["n"][order].astype(np.int64), r["sig"][order], r["root"][order]
        sets = [r["items"][i] for i in order]
        m = len(sets)
        items = np.concatenate(sets)
        owner = np.repeat(np.arange(m), n)
        by_item = np.argsort(items, kind="stable")
        sorted_items, sorted_owner = items[by_item], owner[by_item]

        def common_with(i):
            lo = np.searchsorted(sorted_items, sets[i], "left")
            lengths = np.searchsorted(sorted_items, sets[i], "right") - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            return np.bincount(sorted_owner[at], minlength=m)

        if "d" in r:
            d = r["d"][order]
        else:
            common = common_with(0)
            d = 1 - common / (n + n[0] - common)
        first: dict[int, int] = {}
        parent = [first.setdefault(x, i) for i, x in enumerate(root.tolist())]

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = []
        for i in np.flatnonzero(_outsiders(root)).tolist():
            common = common_with(i)
            near = 100 * common >= PERCENT * (n + n[i] - common)
            near &= (np.abs(d - d[i]) <= EPS + 1e-9) & (root != root[i])
            for j in np.flatnonzero(near).tolist():
                a, b = find(i), find(j)
                if a != b:
                    parent[a] = b
                    links.append((sig[i], sig[j]))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _distances(members: DataFrame, pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` (region, sig, root) times the pivots (region, pivot, proot)
    of their region, with the distance; members linked to a pivot take its root."""
    x = members.join(sets.select("sig", "n", "items"), "sig")
    p = pivots.join(
        sets.select(F.col("sig").alias("pivot"), F.col("n").alias("pn"), F.col("items").alias("pitems")), "pivot"
    )
    j = x.join(p, "region")
    common = F.size(F.array_intersect("items", "pitems"))
    j = j.withColumn("common", common)
    union = F.col("n") + F.col("pn") - F.col("common")
    j = j.withColumn("linked", F.col("common") * 100 >= union * PERCENT)
    return j.select(
        "region", "sig", "n", "pivot", (1 - F.col("common") / union).alias("d"), "linked",
        F.when(F.col("linked"), F.col("proot")).otherwise(F.col("root")).alias("root"),
    )


def _marked(near: DataFrame) -> DataFrame:
    """The rows of regions with several roots, with ``outside``: not of the
    commonest root."""
    times = near.groupBy("region", "root").agg(F.count(F.lit(1)).alias("k"))
    most = times.groupBy("region").agg(F.max(F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    most = most.where(F.col("roots") > 1).select("region", F.col("most.root").alias("most"))
    return near.join(most, "region").withColumn("outside", F.col("root") != F.col("most")).drop("most")


def _near_pivot(near: DataFrame) -> DataFrame:
    """Members that still matter: outsiders, and those that may link to one by
    their distances to the pivot (triangle inequality)."""
    rows = _marked(near)
    of = F.when(F.col("outside"), F.col("d"))
    reach = rows.groupBy("region").agg(F.min(of).alias("least"), F.max(of).alias("most"))
    far = F.lit(EPS + 1e-9)
    near = (F.col("d") >= F.col("least") - far) & (F.col("d") <= F.col("most") + far)
    return rows.join(reach, "region").where(near).drop("least", "most", "linked")


def _sized(rows: DataFrame) -> DataFrame:
    size = rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"),
        F.sum(F.col("outside").cast("int")).alias("outsiders"),
    )
    size = size.where((F.col("members") > 1) & (F.col("outsiders") > 0))
    return size.withColumn("small", (F.col("members") <= REGION_ROWS) & (F.col("shingles") <= REGION_SHINGLES))


def _parts():
    """Blocks of a too large region, two of which fit one task."""
    return F.ceil(2 * F.greatest(F.col("members") / REGION_ROWS, F.col("shingles") / REGION_SHINGLES)).cast("int")


def _worth(large: DataFrame, rows: DataFrame) -> DataFrame:
    """The regions of ``large`` whose cells (``rows``, by ``parent``) take fewer rows
    than the region in pairs of blocks."""
    sent = F.when(F.col("small"), F.col("members")).otherwise(F.col("members") * _parts())
    parent = rows.groupBy("region").agg(F.first("parent").alias("parent"))
    cells = _sized(rows).join(parent, "region").groupBy("parent").agg(F.sum(sent).alias("sent"))
    both = large.join(cells, large["region"] == cells["parent"], "left")
    return both.where(F.coalesce("sent", F.lit(0)) < F.col("members") * _parts()).select("region")


def _local_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    rows = rows.join(sets.select("sig", "items"), "sig")
    return _by_region(rows.select("region", "sig", "n", "d", "root", "items"), _join_region, "a bigint, b bigint")


def _blocks(rows: DataFrame, size: DataFrame) -> DataFrame:
    """Too large regions as all pairs of blocks that fit one task."""
    rows = rows.join(size.select("region", _parts().alias("parts")), "region")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.concat_ws("-", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    return rows.withColumn("region", F.xxhash64("region", pair)).drop("parts", "block", "other")


def _block_links(rows: DataFrame, size: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of too large regions, in pairs of blocks."""
    rows = _blocks(rows.select("region", "sig", "root"), size).join(classes.select("sig", "n", "sketch"), "sig")
    near = scratch.keep(_by_region(rows, _survivors, "region bigint, sig bigint, root bigint"), "near")
    rows = near.join(sets.select("sig", "n", "items"), "sig")
    return scratch.keep(_by_region(rows, _join_region, "a bigint, b bigint"), "links")


def _pivot_links(docs: DataFrame, classes: DataFrame, members: DataFrame, size: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of each class to one pivot: of those it may link to, the one of
    the largest region."""
    s = classes.select("sig", "n", "sketch")
    pairs = members.join(s, "sig").join(
        s.select(F.col("sig").alias("region"), F.col("n").alias("pn"), F.col("sketch").alias("psketch")), "region"
    )
    pairs = pairs.mapInArrow(_pairs_that_may_link, "region bigint, sig bigint")
    best = pairs.join(size.select("region", "members"), "region").groupBy("sig").agg(
        F.max(F.struct("members", "region")).alias("best")
    )
    best = scratch.keep(best.select(F.col("best.region").alias("region"), "sig"), "best")
    # The classes of one pivot in parts that a task takes; the pivot goes to each.
    parts = F.ceil(F.count(F.lit(1)) / REGION_ROWS).cast("int")
    parts = scratch.keep(best.groupBy("region").agg(parts.alias("parts")), "parts")
    part = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("part")
    to = best.join(parts, "region").select("region", part, F.lit(False).alias("is_pivot"), "sig")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    to = to.unionByName(parts.select("region", part, F.lit(True).alias("is_pivot"), F.col("region").alias("sig")))
    rows = to.join(_needed_sets(docs, classes, to, scratch), "sig").select("region", "part", "is_pivot", "sig", "items")
    rows = rows.repartition("region", "part").sortWithinPartitions("region", "part", F.desc("is_pivot"))
    return scratch.keep(rows.mapInArrow(_to_pivot, "a bigint, b bigint"), "stars")


def _roots(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` of the classes that link to a pivot: the pivot, or the
    one that is reached from it by at most three more links. Equal roots are
    connected, which is all that is asked of them; the components come last."""
    at = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(2):
        on = at.select(F.col("node").alias("root"), F.col("root").alias("further"))
        at = at.join(on, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        at = scratch.keep(at, "roots")
    return at


def class_links(docs: DataFrame, classes: DataFrame, repeats: dict[int, int], scratch: Scratch) -> DataFrame:
    """Links ``a, b`` between classes; their components are those of all links."""
    texts = docs.select(docs["text"].cast("string").alias("text"))
    prefixes = texts.mapInArrow(_prefixes(repeats), "s bigint, n int, sig bigint")
    # Runs of compatible sizes among the classes sharing a shingle.
    w = Window.partitionBy("s").orderBy("n", "sig")
    new = F.coalesce(F.lag("n").over(w) * 100 < F.col("n") * PERCENT, F.lit(True))
    runs = prefixes.withColumn("start", F.when(new, F.col("sig")))
    runs = runs.withColumn("pivot", F.last("start", ignorenulls=True).over(w))
    members = runs.where(F.col("pivot") != F.col("sig")).select(F.col("pivot").alias("region"), "sig").distinct()
    members = scratch.keep(members, "members")
    every = members.unionByName(members.select("region", F.col("region").alias("sig")).distinct())
    size = every.join(classes.select("sig", "n"), "sig").groupBy("region").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")
    )
    small = (F.col("members") <= REGION_ROWS) & (F.col("shingles") <= REGION_SHINGLES)
    size = scratch.keep(size.select("region", "members", small.alias("small")), "sizes")
    stars = _pivot_links(docs, classes, members, size, scratch)
    roots = _roots(stars, scratch)
    # Regions whose members are not all joined yet.
    labelled = every.join(roots, every["sig"] == roots["node"], "left").select(
        "region", "sig", F.coalesce("root", "sig").alias("root")
    )
    mixed = labelled.groupBy("region").agg((F.min("root") != F.max("root")).alias("mixed"))
    mixed = mixed.where("mixed").join(size, "region").select("region", "small")
    rest = scratch.keep(labelled.join(mixed, "region"), "rest")
    near = rest.where("small").join(classes.select("sig", "n", "sketch"), "sig").drop("small")
    near = scratch.keep(_by_region(near, _survivors, "region bigint, sig bigint, root bigint"), "near")
    rows = near.join(_needed_sets(docs, classes, near, scratch), "sig")
    links = scratch.keep(_by_region(rows, _join_region, "a bigint, b bigint"), "links")
    links = stars.unionByName(links)
    large = rest.where(~F.col("small")).select("region", "sig", "root")
    if large.isEmpty():
        return links
    return links.unionByName(_large_regions(docs, classes, large, scratch))


def _large_regions(docs: DataFrame, classes: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of regions that no single task should take."""
    pivots = members.where("sig = region").select("region", F.col("sig").alias("pivot"), F.col("root").alias("proot"))
    sets = scratch.keep(_needed_sets(docs, classes, members, scratch), "sets")
    near = scratch.keep(_distances(members, pivots, sets), "distances")
    found = [near.where("linked AND sig != pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b"))]
    rows = scratch.keep(_near_pivot(near.drop("pivot")), "outside")
    for level in range(LEVELS + 1):
        size = scratch.keep(_sized(rows), "sizes")
        if size.isEmpty():
            break
        small = rows.join(size.where("small").select("region"), "region")
        found.append(scratch.keep(_local_links(small, sets), "links"))
        large = size.where(~F.col("small"))
        if large.isEmpty():
            break
        rows = rows.join(large.select("region"), "region")
        if level == LEVELS:
            found.append(_block_links(rows, large, classes, sets, scratch))
            break
        # Pivots of the next level: the outsiders first in hash order.
        by_hash = Window.partitionBy("region").orderBy(F.xxhash64("sig", F.lit(level)))
        pivots = rows.where("outside").withColumn("i", F.row_number().over(by_hash)).where(F.col("i") <= PIVOTS)
        pivots = scratch.keep(
            pivots.select("region", F.col("sig").alias("pivot"), F.col("root").alias("proot")), "pivots"
        )
        near = _distances(rows.select("region", "sig", "root"), pivots, sets)
        # A cell's root is the pivot's only inside its ball; outsiders stay those of the region.
        near = scratch.keep(near.join(rows.select("region", "sig", "outside"), ["region", "sig"]), "distances")
        found.append(near.where("linked AND sig != pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b")))
        home = near.groupBy("region", "sig").agg(F.min(F.struct("d", "pivot")).alias("h"))
        cells = near.join(home.select("region", "sig", "h.*").toDF("region", "sig", "hd", "hp"), ["region", "sig"])
        at_home = F.col("outside") & (F.col("pivot") == F.col("hp"))
        radius = cells.where(at_home).groupBy("region", "pivot").agg(F.max("d").alias("radius"))
        reached = (F.col("d") <= F.col("radius") + F.lit(EPS + 1e-9)) & (F.col("d") <= F.col("hd") + F.lit(2 * EPS + 1e-9))
        cells = cells.join(radius, ["region", "pivot"]).where(at_home | reached)
        cells = cells.where(F.col("sig") != F.col("pivot")).withColumn("parent", F.col("region"))
        cells = cells.withColumn("region", F.xxhash64("region", "pivot"))
        cells = scratch.keep(_near_pivot(cells.drop("pivot", "hd", "hp", "radius", "outside")), "outside")
        worth = scratch.keep(_worth(large, cells), "worth")
        rest = large.join(worth, "region", "left_anti")
        if not rest.isEmpty():
            found.append(_block_links(rows.join(rest.select("region"), "region"), rest, classes, sets, scratch))
        rows = cells.join(worth.select(F.col("region").alias("parent")), "parent").drop("parent")
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    return links


def _id_bucket(name: str):
    return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(ID_BUCKETS)).cast("int").alias("__sg_bucket")


def _id_buckets(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The hash buckets that hold an id of ``ids`` (column ``id``): at most
    ID_BUCKETS numbers, to be broadcast. It lets most rows pass a test by id
    where they are; only those in a bucket need a closer look."""
    return F.broadcast(scratch.keep(ids.select(_id_bucket("id")).distinct(), "buckets"))


def _needed_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """``sig, n, items`` of the classes of ``members`` (and of some more),
    once each, computed where its document lies; no text is shuffled."""
    ids = classes.join(members.select("sig").distinct(), "sig").select(F.col("first_id").alias("id"))
    d = docs.select(_id_bucket("doc_id"), docs["text"].cast("string").alias("text"))
    d = d.join(_id_buckets(ids, scratch), "__sg_bucket", "left_semi").select("text")
    found = d.mapInArrow(_sets, "sig bigint, n int, items array<bigint>").where(F.col("sig").isNotNull())
    # A class comes up twice if its id is null or repeated, or by a copy in
    # another task whose id falls into the same bucket. The join by sig that
    # follows needs the same exchange.
    return found.groupBy("sig").agg(F.first("n").alias("n"), F.first("items").alias("items"))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, n, sig`` of all documents, and ``sig, first_sig,
    component_id`` of all classes; ``first_sig`` is the class that holds the
    component's smallest id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = scratch.keep(
        docs.mapInArrow(_classify, "doc_id bigint, n int, sig bigint, sketch binary, bucket int, repeats bigint"), "classes"
    )
    one = kept.where(F.col("bucket").isNull())
    rows = one.select("doc_id", "n", "sig")
    # At most BUCKETS rows.
    counted = kept.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("repeats").alias("n")).collect()
    repeats = {r["bucket"]: r["n"] for r in counted}
    classes = scratch.keep(
        one.where(F.col("n") > 0).groupBy("sig").agg(
            F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")
        ), "first"
    )
    links = class_links(docs, classes, repeats, scratch)
    roots = components(links, scratch)
    linked = roots.join(classes, F.col("node") == F.col("sig")).select("sig", "root", "first_id")
    order = F.struct(F.col("first_id").isNull(), "first_id", "sig")
    first = linked.groupBy("root").agg(F.min(order).alias("f")).select("root", "f.first_id", F.col("f.sig").alias("first_sig"))
    linked = linked.select("sig", "root").join(first, "root").select("sig", "first_sig", F.col("first_id").alias("component_id"))
    of = classes.join(linked, "sig", "left").select(
        "sig", F.coalesce("first_sig", "sig").alias("first_sig"),
        F.when(F.col("first_sig").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return rows, scratch.keep(of, "components")


def join_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    rows, of = _joined(docs)
    n = F.col("n").cast("long").alias("n_shingles")
    some = rows.where(F.col("n") > 0).join(of, "sig").select("doc_id", n, "component_id")
    none = rows.where(F.col("n") == 0).select("doc_id", n, F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def _with_sig(names: list[str]):
    """Map function: the rows, with the hash of their class."""
    at = names.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sigs = []
            for k in range(0, b.num_rows, ROWS):
                for t in b.column(at).slice(k, ROWS).to_pylist():
                    s = shingle_set(t)
                    sigs.append(class_hash(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigs, pa.int64())], [*names, "__sg_sig"])

    return run


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the
    row with the smallest id; rows without words all stay.

    Ids that occur once (the rule) are kept or dropped by id. Rows whose id is
    null or repeated are told apart by their class as well, and one row of the
    kept class stays.
    """
    rows, of = _joined(docs)
    times = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    best = rows.where(F.col("n") > 0).join(of, "sig")
    best = best.where((F.col("sig") == F.col("first_sig")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = best.select("doc_id").unionByName(rows.where(F.col("n") == 0).select("doc_id"))
    scratch = Scratch(docs.sparkSession, "jaccard")
    stay = scratch.keep(stay.select(F.col("doc_id").alias("id")), "stay")
    odd = scratch.keep(
        times.where((F.col("times") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("id")), "odd"
    )
    once = times.where((F.col("times") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"))
    gone = once.join(stay, "id", "left_anti")
    # Rows whose id falls into no bucket of a dropped or odd id stay where they
    # are; the others are looked up by id.
    buckets = _id_buckets(gone.unionByName(odd), scratch)
    names = docs.columns
    keyed = docs.withColumn("__sg_bucket", _id_bucket("doc_id"))
    sure = keyed.join(buckets, "__sg_bucket", "left_anti").drop("__sg_bucket")
    near = keyed.join(buckets, "__sg_bucket", "left_semi").drop("__sg_bucket")
    ids = stay.join(odd, "id", "left_anti").select(F.col("id").alias("__sg_id"))
    out = sure.unionByName(near.join(ids, near["doc_id"].cast("long") == ids["__sg_id"], "left_semi"))
    if odd.isEmpty():
        return out
    odd = odd.select(F.col("id").alias("__sg_id"))
    odd = near.join(odd, near["doc_id"].cast("long").eqNullSafe(odd["__sg_id"]), "left_semi")
    schema = type(docs.schema)([*docs.schema.fields]).add("__sg_sig", "long")
    odd = scratch.keep(odd.mapInArrow(_with_sig(names), schema), "odd")
    best = best.select(F.col("sig").alias("__sg_best"), F.col("doc_id").alias("__sg_id")).distinct()
    one = odd.join(best, (odd["__sg_sig"] == best["__sg_best"]) & odd["doc_id"].cast("long").eqNullSafe(best["__sg_id"]))
    one = one.groupBy("__sg_sig").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("row")).select("row.*")
    empty = odd.where(F.col("__sg_sig").isNull()).select(*[F.col(f"`{c}`") for c in names])
    return out.unionByName(one).unionByName(empty)


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
