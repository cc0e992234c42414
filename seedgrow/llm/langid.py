"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams
(n = 1..3, over lower-cased letters with blanks around words), by frequency.
A text is ranked the same way; its out-of-place distance to a profile is the
sum over the text's n-grams of how far their ranks lie apart, or the largest
possible distance for an n-gram that the profile lacks. The nearest profile
wins; ties go to the smaller name.

The score is 1 - d / d_max for the winner's distance d and the largest
possible distance d_max: 0 when no n-gram of the text is in the profile.

Scale: training counts n-grams per task and adds them up by (language,
n-gram) with a partial aggregate, so a language holding most rows collapses
before the shuffle; the top of each list is cut in two steps (per salt, then
per language). The profiles are at most PROFILE rows per language. Prediction
is a map over Arrow batches. Counts held by a task are flushed at a fixed
number of entries; whole texts are counted, a batch slice at a time.

Edge cases: null text or a text without a letter is ``und`` with score 0;
without any training row every text is ``und``; a null lang is not learned
from; a null doc_id counts as the text 'null' for the split; repeated rows
get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedgrow.llm.common import read_table

# Length of a profile, n-gram lengths, entries a task may hold,
# rows handled at once, salts of the first cut.
PROFILE = 400
LONGEST = 3
FLUSH = 400_000
ROWS = 64
SALTS = 64
UNKNOWN = "und"

_SPACE = 32
_BITS = 21
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    global _LETTER
    if _LETTER is None:
        t = np.full(0x110000, _SPACE, dtype=np.int64)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                t[c] = c
        _LETTER = t
    return _LETTER


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as packed code points, and their counts.

    An n-gram (a, b, c) is packed as a*2^42 + b*2^21 + c; shorter ones have
    leading zeros. Runs of non-letters count as one blank; the text begins
    and ends with a blank; n-grams of a blank alone are left out.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _letters()[codes]
    gap = x == _SPACE
    x = x[~(gap & np.concatenate(([True], gap[:-1])))] if len(x) else x
    if len(x) and x[-1] == _SPACE:
        x = x[:-1]
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.concatenate(([_SPACE], x, [_SPACE]))
    grams = [x[x != _SPACE]]
    two = x[:-1] << _BITS | x[1:]
    grams.append(two)
    three = two[:-1] << _BITS | x[2:]
    grams.append(three[x[1:-1] != _SPACE])
    g = np.sort(np.concatenate(grams))
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.diff(np.append(first, len(g)))


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The ``top`` most frequent keys, by count then key."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:top]


def held_out():
    """True where crc32 of the id, as text, leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def train(docs: DataFrame, top: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from all rows of ``docs`` with a lang and a text."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list] = {}

        def merge():
            """Distinct n-grams of each language, one language at a time."""
            for lang, parts in held.items():
                k, n = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                order = np.argsort(k, kind="stable")
                k, n = k[order], n[order]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                parts.append((k[first], np.add.reduceat(n, first)))
            return sum(len(parts[0][0]) for parts in held.values())

        def flush():
            merge()
            for lang, [(k, n)] in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"]
                )
            held.clear()

        size = 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    k, n = ngram_counts(text)
                    if len(k):
                        held.setdefault(lang, []).append((k, n))
                        size += len(k)
                        if size >= FLUSH * 3:
                            # Merge first: flush only what stays large.
                            size = merge()
                            if size >= FLUSH:
                                yield from flush()
                                size = 0
        yield from flush()

    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = rows.mapInArrow(count, "lang string, gram bigint, n bigint")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    salt = F.pmod(F.xxhash64("gram"), F.lit(SALTS))
    order = [F.desc("n"), F.asc("gram")]
    for key in (["lang", salt], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        grams = grams.withColumn("place", place).where(F.col("place") <= top)
    # At most ``top`` rows per language.
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in grams.select("lang", "gram", "place").collect():
        profiles.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {lang: [g for _, g in sorted(p)] for lang, p in sorted(profiles.items())}


class RankOrder:
    """The out-of-place classifier over packed profiles."""

    def __init__(self, profiles: dict[str, list[int]], top: int = PROFILE):
        self.langs = sorted(profiles)
        self.top = top
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            p = np.array(profiles[lang], dtype=np.int64)
            self.ranks[np.searchsorted(self.grams, p), j] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        mine = ranked(*ngram_counts(text), self.top)
        if not len(mine):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == mine)[:, None], self.ranks[at], -1)
        gap = np.where(ranks >= 0, np.abs(ranks - np.arange(len(mine))[:, None]), self.top)
        d = gap.sum(axis=0)
        j = int(np.argmin(d))
        return self.langs[j], 1.0 - float(d[j]) / (self.top * len(mine))


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = PROFILE) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``; only ``text`` is looked at."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = RankOrder(profiles, top)
        for b in batches:
            langs, scores = [], []
            for k in range(0, b.num_rows, ROWS):
                for t in b.column(at).slice(k, ROWS).to_pylist():
                    lang, score = model.predict(t)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
