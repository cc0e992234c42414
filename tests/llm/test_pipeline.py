"""The corpus pipeline, stage by stage, against brute force."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

import __spark_entry__
from seedgrow.llm import langid, mixing, queries
from llm.test_pair_ops import brute_join
from llm.test_pii import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame(
        [(9001, None, "en", "src1", 0), (9002, "123 456", "en", "src1", 7), (9003, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(junk)
    seen = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert seen[-1].columns == docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    # 1: only texts without a language go; lang is the prediction.
    one = {r["doc_id"]: r for r in seen[1].collect()}
    assert set(before) - set(one) == {9001, 9002, 9003}
    model = langid.RankOrder(langid.train(docs.where(~langid.held_out())))
    assert all(r["lang"] == model.predict(r["text"])[0] for r in one.values())
    # 2: the smallest id of each group stays.
    groups = brute_join([(i, r["text"]) for i, r in one.items()])
    two = {r["doc_id"]: r for r in seen[2].collect()}
    assert set(two) == {c for _, c in groups.values()}
    # 3: every base span is gone; the rest of the text is unchanged.
    three = {r["doc_id"]: r for r in seen[3].collect()}
    assert set(three) == set(two)
    for i, r in three.items():
        want = two[i]["text"]
        for s in sorted(filter(None, brute(want).split(",")), key=lambda x: -int(x.split(":")[1])):
            kind, a, b = s.split(":")
            want = want[: int(a)] + f"<{kind.upper()}>" + want[int(b) :]
        assert r["text"] == want and r["n_chars"] == len(want)
    # 4: rows as often as the mixture draws them.
    drawn = {r["doc_id"]: r["copies"] for r in mixing.draw(seen[3]).collect()}
    four = {r["doc_id"]: r["count"] for r in seen[4].groupBy("doc_id").count().collect()}
    assert four == {k: v for k, v in drawn.items() if v}
    # 5: one row of tokens for each emitted document.
    assert seen[5].count() == seen[4].count()
    assert seen[5].where("n_tokens <= 0").count() == 0
    assert pipeline.run(spark, SF).agg(F.sum("n_tokens")).first()[0] > 0


def test_stages_on_an_empty_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, d, SF)
        assert out.count() == 0


def test_registered_queries():
    names = [k for k in __spark_entry__.queries() if k.startswith("op") or k == "pipeline"]
    assert sorted(int(k[2:].split("_")[0]) for k in names if k != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_workers_keep_no_words(monkeypatch):
    """What a task remembers of its words goes with it: a worker's memory is
    needed by the stages that follow."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from seedgrow.llm import bpe, jaccard_join

    text = " ".join(f"w{i}" for i in range(100_000))
    jaccard_join.shingle_set("one two three")
    tracemalloc.start()
    s = jaccard_join.shingle_set(text)
    held = tracemalloc.get_traced_memory()[0] - s.nbytes
    tracemalloc.stop()
    assert len(s) == 99_996 and held < 1_000_000

    class Docs:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def __getitem__(self, name):
            return F.col(name)

        def select(self, *columns):
            return self

        def mapInArrow(self, fn, schema):
            self.fn = fn
            return self

    monkeypatch.setattr(F, "col", lambda name: type("C", (), {"cast": lambda c, t: c, "alias": lambda c, n: c})())
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(3), "text": ["some words here", None, "unseenword"]})
    for fn in (bpe.digests, bpe.encode):
        out = list(fn(Docs()).fn(iter([batch])))
        assert sum(b.num_rows for b in out) == 3
        tok = bpe.load(bpe.default_path())
        assert not tok.known and not tok.cache


def test_word_hashes_tell_words_apart():
    from seedgrow.llm import jaccard_join

    texts = ["", " ", "a", " ab  A\tb\x0bB\x0cab\r\nÜ ü \x1c \x85 x", "ab ba aab aba baa a\x00 a\x00\x00 " + "a" * 700 + " " + "a" * 701]
    seen = {}
    for t in texts:
        words = t.encode().lower().split()
        h = jaccard_join._word_hashes(t.encode().lower()).tolist()
        assert len(h) == len(words)
        for w, x in zip(words, h):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
