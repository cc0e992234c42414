"""Letter frequencies against the plain definition, letter by letter."""

from __future__ import annotations

import random

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from seedgrow.sources.tables import LETTERS, letter_frequencies

TEXTS = [None, "", " ", "aAbB zZ", "K kelvin", "İstanbul", "éÀ ẞ ß", "😀a😀", "abc" * 50_000, "1234", "\x00a", "Σίσυφος Ω z"]


def plain(text):
    t = F.lower(F.col(text))
    n = F.length(t)
    return F.array(*[F.when(n > 0, (n - F.length(F.replace(t, F.lit(c), F.lit("")))) / n).otherwise(F.lit(0.0)) for c in LETTERS])


def test_equal_to_the_plain_definition(spark):
    rng = random.Random(3)
    more = ["".join(chr(rng.choice([65, 97, 0xC0, 0x400, 0x4E00, 0x1F600]) + rng.randrange(26)) for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(TEXTS + more)), "i int, text string").repartition(3)
    got = df.select("i", "text", vector_to_array(letter_frequencies("text")).alias("got"), plain("text").alias("want"))
    rows = got.where(F.col("i") % 5 != 2).collect()
    assert len(rows) > 150
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_each_text_is_lowered_and_read_once(spark):
    """Not once a letter: the time of all queries on documents went there."""
    df = spark.createDataFrame([(1, "a")], "i int, text string").select("i", letter_frequencies("text").alias("f"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "replace(" not in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string").select(letter_frequencies("text").alias("f"))
    assert df.count() == 0 and df.collect() == []
