"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every five-word shingle is hashed (60 bits of md5); the
sketch keeps each hash below a fixed fraction (1/8) of the hash space. What is
kept depends on the shingle alone, so sketches of unequal documents are
comparable: containment of one in the other is estimated on the smaller one,
and the sketch of a union is the union of the sketches. A text none of whose
hashes is below the threshold keeps its smallest one; merging stays exact
(``merge``: the hashes below the threshold, or else the smallest of all).

The fingerprint is the sorted distinct hashes, in hex, concatenated.

Scale: a sketch is one projection. The comparison with the next document in
descending id order never sorts texts: ids alone are range-partitioned, the
predecessor of each id is found within its range (plus one row per range for
the borders), and each document sends the head its predecessor needs, with
its sketch, in one keyed shuffle.

Edge cases: null text is empty, with an empty fingerprint; a text of fewer
than five words has its whole sequence as one shingle; two empty sketches have
likeness 1, an empty and a non-empty one 0. Rows sharing an id have the same
next document; the next document of an id that occurs repeatedly is the row
with the smallest digest. A null id comes after all others. A lone document is
its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedgrow.llm.common import WORD, Scratch, read_table, text_or_empty

# Words of a shingle, hex digits of a hash, and the threshold:
# the leading hex digit is below '2', which is 1/8 of all hashes.
WORDS = 5
DIGITS = 15
BELOW = "2"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingle_hashes(w: Column) -> Column:
    """md5 of every shingle of a word array, in order."""
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1))),
        lambda i: F.md5(F.array_join(F.slice(w, i, WORDS), " ")),
    )
    return F.when(F.size(w) > 0, every).otherwise(F.array().cast("array<string>"))


def _number(h: Column) -> Column:
    """The leading digits of a hash as a number: 8 bytes in a shuffle, not 24."""
    return F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("long")


def below(hashes: Column) -> Column:
    """The hashes below the threshold, in order, as numbers."""
    return F.transform(F.filter(hashes, lambda h: h < BELOW), _number)


def written(sketch: Column) -> Column:
    """The fingerprint string of a sketch."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, F.lit("0"))), "")


def retain(hashes: Column) -> Column:
    """Hashes below the threshold, or else the smallest, as numbers; sorted,
    distinct."""
    low = below(hashes)
    least = F.transform(F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull()), _number)
    return F.sort_array(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(least)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two documents' shingles."""
    every = F.array_union(a, b)
    limit = F.lit(int(BELOW, 16) << 4 * (DIGITS - 1))
    low = F.filter(every, lambda x: x < limit)
    least = F.filter(F.array(F.array_min(every)), lambda x: x.isNotNull())
    return F.sort_array(F.when(F.size(low) > 0, low).otherwise(least))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles in the other."""
    least = F.least(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    both = F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(least == 0, both).otherwise(common / least)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint_hashes") -> DataFrame:
    """``docs`` plus the sketch of ``text`` as a sorted array of hashes."""
    d = docs.withColumn("__sg_words", words(text_or_empty(text)))
    d = d.withColumn("__sg_hashes", shingle_hashes(F.col("__sg_words")))
    return d.withColumn(out, retain(F.col("__sg_hashes"))).drop("__sg_words", "__sg_hashes")


def previous_ids(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """For each distinct id the one before it in descending order, cyclic.

    ``ids``: ``id, need, canon`` with distinct ids. Returns ``id, canon,
    prev_id, prev_need``.
    """
    order = F.desc_nulls_last("id")
    kept = scratch.keep(
        ids.repartitionByRange(order).withColumn("bucket", F.spark_partition_id()), "ids"
    )
    within = Window.partitionBy("bucket").orderBy(order)
    row = F.struct("id", "need")
    chain = kept.select(
        "id", "canon", "bucket", F.lag(row).over(within).alias("prev"), F.row_number().over(within).alias("i")
    )
    # Borders: the last id of the nearest earlier range (one row per range).
    # A null id is the smallest of its range, as it is last in descending order.
    last = kept.groupBy("bucket").agg(F.min(row).alias("e"))
    by_bucket = Window.orderBy("bucket")
    cyclic = F.coalesce(F.lag("e").over(by_bucket), F.last("e").over(by_bucket.rowsBetween(0, Window.unboundedFollowing)))
    last = last.select(F.col("bucket").alias("b"), cyclic.alias("border"))
    chain = chain.join(last, (F.col("bucket") == F.col("b")) & (F.col("i") == 1), "left")
    prev = F.coalesce("prev", "border")
    return chain.select("id", "canon", prev["id"].alias("prev_id"), prev["need"].alias("prev_need"))


def _stays() -> Column:
    return F.expr("left(text, cast(length(text) - floor(length(text) / 3) as int))")


def _complete(stay_words: Column, stays: Column) -> Column:
    """Number of words that surely end within the part that stays."""
    open_end = stays.rlike(r"[^\x20\x09-\x0D]\z")
    return F.size(stay_words) - F.when(open_end, F.lit(1)).otherwise(F.lit(0))


def kept_part(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the sketch in two parts, as a later replacement of
    the text's last third leaves one of them unchanged (sketches merge).

    ``kept_first``: the hashes below the threshold of shingles that lie wholly
    in the complete words of the part that stays; ``kept_rest``: the others
    (the smallest hash, if none is below the threshold).
    """
    none = F.array().cast("array<bigint>")
    d = docs.select("doc_id", "text", words(F.col("text")).alias("w"), _stays().alias("stays"))
    d = d.withColumn("hashes", shingle_hashes(F.col("w")))
    d = d.withColumn("first", F.greatest(_complete(words(F.col("stays")), F.col("stays")) - (WORDS - 1), F.lit(0)))
    low_first = F.when(F.col("first") > 0, below(F.slice("hashes", F.lit(1), F.greatest("first", F.lit(1))))).otherwise(none)
    low_rest = below(F.slice("hashes", F.col("first") + 1, F.greatest(F.size("hashes"), F.lit(1))))
    d = d.withColumns({"low_first": low_first, "low_rest": low_rest})
    empty = F.size("low_first") + F.size("low_rest") == 0
    return d.select(
        "doc_id", "text", F.col("low_first").alias("kept_first"),
        F.when(empty, retain(F.col("hashes"))).otherwise(F.col("low_rest")).alias("kept_rest"),
    )


def _keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` plus a join key without nulls for the id ``name``."""
    return df.withColumns({"k": F.coalesce(F.col(name), F.lit(0).cast("long")), "k_null": F.col(name).isNull()})


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, kept_first, sketch``, ``head`` (of the next document's
    text, as many code points as the last third of this text has) and
    ``next_sketch``."""
    scratch = Scratch(docs.sparkSession, "fingerprint")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = whole.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.floor(F.length("text") / 3)).alias("need"), F.min(F.md5("text")).alias("canon")
    )
    prev = scratch.keep(previous_ids(ids, scratch), "previous")
    # Both uses of ``base`` need the same columns keyed by id: one exchange
    # of the corpus serves both.
    base = _keyed(kept_part(whole), "doc_id").drop("doc_id")
    sketch = F.sort_array(F.array_distinct(F.concat("kept_first", "kept_rest")))
    sent = base.join(_keyed(prev, "id"), ["k", "k_null"]).drop("k", "k_null")
    # Inside coalesce, so that it is no join key (which would change the exchange).
    sent = sent.where(F.coalesce(F.md5("text") == F.col("canon"), F.lit(False)))
    sent = sent.select(
        "prev_id", F.struct(F.expr("left(text, cast(prev_need as int))").alias("head"), sketch.alias("sketch")).alias("next")
    )
    sent = _keyed(sent, "prev_id").groupBy("k", "k_null").agg(F.first("next").alias("next"))
    out = base.join(sent, ["k", "k_null"], "left")
    return out.select(
        F.when(~F.col("k_null"), F.col("k")).alias("doc_id"), "text", "kept_first", sketch.alias("sketch"),
        F.expr("left(next.head, cast(floor(length(text) / 3) as int))").alias("head"),
        F.col("next.sketch").alias("next_sketch"),
    )


def edited_sketch(d: DataFrame) -> DataFrame:
    """``d`` (of ``with_next``) plus the edited text and its sketch: what stays
    is merged with the hashes of the words from the last four complete ones
    on. Only a text too short, or with no hash below the threshold, is hashed
    anew."""
    none = F.array().cast("array<string>")
    d = d.withColumns({"stays": _stays(), "edited": F.concat(_stays(), "head")})
    # Word arrays are columns of their own: inside a lambda they would be
    # computed again for every shingle.
    d = d.withColumn("stay_words", words(F.col("stays")))
    d = d.withColumn("complete", _complete(F.col("stay_words"), F.col("stays")))
    gap = F.when(F.col("complete") == F.size("stay_words"), F.lit(" ")).otherwise(F.lit(""))
    last = F.slice("stay_words", F.greatest(F.col("complete") - (WORDS - 2), F.lit(1)), F.lit(WORDS))
    tail = F.concat(F.array_join(last, " "), gap, "head")
    d = d.withColumn("tail_words", F.when(F.col("complete") >= WORDS, words(tail)).otherwise(none))
    d = d.withColumn("tail_low", below(shingle_hashes(F.col("tail_words"))))
    merged = F.concat("kept_first", "tail_low")
    d = d.withColumn("merged", F.when(F.col("complete") >= WORDS, merged).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("new_words", F.when(F.size("merged") == 0, words(F.col("edited"))).otherwise(none))
    d = d.withColumn("new_hashes", shingle_hashes(F.col("new_words")))
    merged = F.sort_array(F.array_distinct("merged"))
    d = d.withColumn("edited_sketch", F.when(F.size("merged") > 0, merged).otherwise(retain(F.col("new_hashes"))))
    return d.drop("stays", "stay_words", "complete", "tail_words", "tail_low", "merged", "new_words", "new_hashes")


def op8_fingerprint(spark, sf_dir: str) -> DataFrame:
    d = edited_sketch(with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    a, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(a).alias("fingerprint"), written(e).alias("edited_fingerprint"),
        likeness(a, e).alias("near_edited"), likeness(a, x).alias("near_next"),
        containment(a, e).alias("contained_edited"), containment(a, x).alias("contained_next"),
    )


def _sketch_sql(text: str, alias: str) -> list[str]:
    """Two successive select items computing ``alias`` from ``text``."""
    w = f"regexp_extract_all(lower({text}), '{WORD}')"
    h = (
        f"CASE WHEN len({alias}_w) >= {WORDS} THEN list_transform(range(1, len({alias}_w) - {WORDS - 2}), "
        f"lambda i : substr(md5(array_to_string({alias}_w[i:i + {WORDS - 1}], ' ')), 1, {DIGITS})) "
        f"WHEN len({alias}_w) > 0 THEN [substr(md5(array_to_string({alias}_w, ' ')), 1, {DIGITS})] "
        f"ELSE []::VARCHAR[] END"
    )
    k = (
        f"list_sort(list_distinct(CASE WHEN len(list_filter({alias}_h, lambda x : x < '{BELOW}')) > 0 "
        f"THEN list_filter({alias}_h, lambda x : x < '{BELOW}') "
        f"WHEN len({alias}_h) > 0 THEN [list_min({alias}_h)] ELSE []::VARCHAR[] END))"
    )
    return [f"{w} AS {alias}_w", f"{h} AS {alias}_h", f"{k} AS {alias}"]


def op8_sql() -> str:
    aw, ah, ak = _sketch_sql("text", "a")
    ew, eh, ek = _sketch_sql("edited", "e")

    def jac(x, y):
        i = f"len(list_intersect({x}, {y}))"
        u = f"(len({x}) + len({y}) - {i})"
        return f"CASE WHEN {u} = 0 THEN 1.0 ELSE {i}::DOUBLE / {u} END"

    def con(x, y):
        lo, hi = f"least(len({x}), len({y}))", f"greatest(len({x}), len({y}))"
        return (
            f"CASE WHEN {hi} = 0 THEN 1.0 WHEN {lo} = 0 THEN 0.0 "
            f"ELSE len(list_intersect({x}, {y}))::DOUBLE / {lo} END"
        )

    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, {aw} FROM t), h AS (SELECT *, {ah} FROM w), k AS (SELECT doc_id, text, {ak} FROM h),
    n AS (
      SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nt,
        coalesce(lead(a) OVER o, first_value(a) OVER o) AS x
      FROM k WINDOW o AS (ORDER BY doc_id DESC NULLS LAST)),
    ed AS (
      SELECT *, substr(text, 1, (length(text) - length(text) // 3)::BIGINT)
        || substr(nt, 1, (length(text) // 3)::BIGINT) AS edited FROM n),
    ew AS (SELECT *, {ew} FROM ed), eh AS (SELECT *, {eh} FROM ew), ek AS (SELECT *, {ek} FROM eh)
    SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
      array_to_string(a, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
      {jac('a', 'e')} AS near_edited, {jac('a', 'x')} AS near_next,
      {con('a', 'e')} AS contained_edited, {con('a', 'x')} AS contained_next
    FROM ek"""
