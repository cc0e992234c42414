"""BPE encoding and decoding by forced-boundary splitting.

A merge only ever joins two neighbours into a vocabulary token. So a pair of
neighbouring symbols that occurs inside no token can never end up in one
token: the cut between them is certain. A word is split at all certain cuts,
the fragments are encoded independently, and their ids are concatenated.
Fragments are shorter and repeat far more often than words, so most come from
a bounded cache.

The tokenizer file names the vocabulary, the ranked merges, the normaliser
(NFC, white space to one space, lower case) and the pattern that cuts a text
into words; the last symbol of a word carries the end-of-word suffix. Strings
of added tokens are cut out of the raw text first.

Scale: a map over Arrow batches; nothing is shuffled, memory is the vocabulary
plus the bounded cache plus one batch. The vocabulary file is read where the
task runs (its path is a parameter), and reused by later tasks of a worker.

Edge cases: null text is empty (no ids; the digests are of the empty string);
repeated rows get equal results; row order is irrelevant; very long words are
merged with a heap, in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame

from seedgrow.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"
CACHE_ENTRIES = 400_000
# Bits of an id in a packed number; more than any packed rank.
SHIFT = 20
NEVER = 1 << 60
# Fragments up to this length are merged by scanning, longer ones by a heap.
SHORT = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: printable Latin-1 characters stand
    for themselves, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Tokenizer:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in {**self.vocab, **self.added}.items()}
        self.written = {i: str(i) for i in self.token_of}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        v = self.vocab
        # left id and right id in one number -> rank and merged id in one.
        self.merge = {v[a] << SHIFT | v[b]: r << SHIFT | v[a + b] for r, (a, b) in enumerate(merges)}
        splits = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None
        # bytes -> symbols, by Latin-1: byte b becomes symbol number b.
        self.symbols = dict(enumerate(byte_symbols()))
        self.inside = self._pairs_inside()
        self.cache: dict[str, list[int]] = {}
        self.known: dict[str, list[int]] = {}

    def _pairs_inside(self) -> set[str]:
        """Pairs of neighbouring symbols that occur inside some token.

        The pair of the last symbol is kept apart when it carries the suffix:
        ``ab`` + suffix allows the pair only at the end of a word.
        """
        pairs: set[str] = set()
        for t in self.vocab:
            end = bool(self.suffix) and t.endswith(self.suffix) and t != self.suffix
            body = t[: -len(self.suffix)] if end else t
            for i in range(len(body) - 1):
                last = end and i == len(body) - 2
                pairs.add(body[i : i + 2] + (" " if last else ""))
        return pairs

    def fragments(self, word: str) -> list[tuple[str, bool]]:
        """The word's pieces between certain cuts; True marks the last."""
        inside, n, out, start = self.inside, len(word), [], 0
        for i in range(n - 1):
            pair = word[i : i + 2]
            if (pair + " " if i == n - 2 and self.suffix else pair) not in inside:
                out.append((word[start : i + 1], False))
                start = i + 1
        out.append((word[start:], True))
        return out

    def merge_fragment(self, symbols: str, last: bool) -> list[int]:
        """Merge by rank, leftmost first among equals (a heap over a linked
        list: n log n even for one very long fragment)."""
        v = self.vocab
        ids = [v[c] for c in symbols]
        if last and self.suffix:
            ids[-1] = v[symbols[-1] + self.suffix]
        n = len(ids)
        if n == 1:
            return ids
        get, mask = self.merge.get, (1 << SHIFT) - 1
        if n <= SHORT:
            best = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
            while best:
                m = min(best)
                if m == NEVER:
                    break
                i = best.index(m)
                new = m & mask
                ids[i : i + 2] = (new,)
                del best[i]
                if i < len(best):
                    best[i] = get(new << SHIFT | ids[i + 1], NEVER)
                if i:
                    best[i - 1] = get(ids[i - 1] << SHIFT | new, NEVER)
            return ids
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            new = m & mask
            ids[i], ids[j] = new, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (m := get(new << SHIFT | ids[k])) is not None:
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if h >= 0 and (m := get(ids[h] << SHIFT | new)) is not None:
                heapq.heappush(heap, (m, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in symbols."""
        cache, out = self.cache, []
        for piece, last in self.fragments(word):
            key = piece + " " if last else piece
            ids = cache.get(key)
            if ids is None:
                ids = self.merge_fragment(piece, last)
                if len(piece) <= 64:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[key] = ids
            out += ids
        return out

    def normalize(self, text: str) -> str:
        # White space only separates words, so its runs need no rewriting.
        # Lower case letter by letter: no special form of a final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_plain(self, text: str, out: list[int]) -> None:
        symbols = self.symbols
        known = self.known
        for w in self.words.findall(self.normalize(text)):
            ids = known.get(w)
            if ids is None:
                ids = self.encode_word(w.encode().decode("latin-1").translate(symbols))
                if len(w) <= 32:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[w] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.special is None:
            self.encode_plain(text, out)
            return out
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(self.added[part])
            elif part:
                self.encode_plain(part, out)
        return out

    @contextmanager
    def task(self):
        """The words kept for a task go with it: a worker lives on for other
        stages, which need its memory."""
        try:
            yield self
        finally:
            self.cache.clear()
            self.known.clear()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: the tokens, joined by blanks."""
        return " ".join(map(self.token_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row."""
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with load(path).task() as tok:
            for b in batches:
                for k in range(0, b.num_rows, ROWS):
                    part = b.slice(k, ROWS)
                    ids = [tok.encode(t or "") for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                    )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text``, decoded from ``ids``."""
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = load(path)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                texts = [tok.decode(i or []) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


# Rows handled at once inside an Arrow batch: bounds the memory of their ids.
ROWS = 256


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        with load(path).task() as tok:
            for b in batches:
                counts, ids_sha, text_sha = [], [], []
                for k in range(0, b.num_rows, ROWS):
                    for t in b.column("text").slice(k, ROWS).to_pylist():
                        ids = tok.encode(t or "")
                        counts.append(len(ids))
                        ids_sha.append(sha(" ".join(map(tok.written.__getitem__, ids))))
                        text_sha.append(sha(tok.decode(ids)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
