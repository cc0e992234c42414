"""Mixing sources to target weights.

Every source gets a target number of words: the sources, in code point order
with null last, weigh 5, 2, 1, 5, 2, 1 ... and share ``share`` (150 %) of all
words; no target exceeds ``cap`` (2) times its source's words, and what a
capped source leaves is shared again by weight among the rest until none is
above its cap. With r = cap * size / weight, the sources that end up capped
are those with the smallest r, so the fixed point of the resharing is found
in closed form by one running sum over the sources ordered by r.

A document is then emitted floor(rate) times, rate = target / source words,
plus once more when a hash of its id falls below the fraction of the rate.

Scale: one partial aggregate per source (a hot source collapses map-side),
windows over one row per source, and a map-side or skew-splittable join of
the documents with that small table. The table is written first, so the
planner broadcasts it only if its true size is below the threshold. Documents
never shuffle in the broadcast case.

Edge cases: null text has size 0; null and '' are two different sources; a
source without words has target 0 and none of its rows are emitted; repeated
rows (or rows sharing an id) draw the same number, so they are emitted the
same number of times; a null id draws as the text 'null'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedgrow.functions.hashing import unit_hash, unit_hash_sql
from seedgrow.llm.common import WORD, Scratch, read_table

# The cycle of weights, the share of all words, the cap and the
# seed of the draw.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 42


def size_column(text: str = "text"):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``.

    ``sizes`` has ``source`` and ``__sg_size``.
    """
    src = sizes.groupBy("source").agg(F.sum("__sg_size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    i = F.row_number().over(by_name) - 1
    weight = F.lit(WEIGHTS[-1])
    for k, w in enumerate(WEIGHTS[:-1]):
        weight = F.when(i % len(WEIGHTS) == k, F.lit(w)).otherwise(weight)
    src = src.select("source", "source_size", i.alias("rank"), weight.cast("double").alias("weight"))
    src = src.withColumn("cap", F.col("source_size") * F.lit(CAP))
    src = src.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    src = src.withColumn("level", left_words / left_weight)
    # The first source whose cap lies above the level is the first uncapped one.
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))
    src = src.withColumn("share", F.min(free).over(every)["level"])
    target = F.when(F.col("share").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("share") * F.col("weight"))
    )
    src = src.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return src.select("source", "source_size", "target", rate.alias("rate"))


def draw(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` plus ``size, source_size, target, copies``; one row per row."""
    sizes = docs.select("source", size_column().alias("__sg_size"))
    targets = Scratch(docs.sparkSession, "mix").keep(source_targets(sizes), "targets")
    targets = targets.select(
        F.col("source").alias("__sg_source"),
        F.col("source_size").alias("__sg_total"),
        F.col("target").alias("__sg_target"),
        F.col("rate").alias("__sg_rate"),
    )
    rows = docs.withColumn("size", size_column())
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["__sg_source"]), "left")
    u = unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)
    whole = F.floor("__sg_rate")
    copies = whole + F.when(u < F.col("__sg_rate") - whole, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumns(
        {"source_size": F.col("__sg_total"), "target": F.col("__sg_target"), "copies": copies.cast("int")}
    )
    return rows.drop("__sg_source", "__sg_total", "__sg_target", "__sg_rate")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture: each row of ``docs`` repeated as often as it is drawn."""
    drawn = draw(docs.withColumn("__sg_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), seed)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__sg_copy")
    drawn = drawn.where(F.col("copies") > 0).select("__sg_row", copy)
    return drawn.select("__sg_row.*")


def op2_mix(spark, sf_dir: str) -> DataFrame:
    d = draw(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sql(docs: str = "documents") -> tuple[str, str]:
    """DuckDB: CTEs that end in ``__drawn`` (the rows of ``docs`` with
    ``size, source_size, target, copies``), and the name of that CTE."""
    u = unit_hash_sql("coalesce(CAST(d.doc_id AS VARCHAR), 'null')", SEED)
    cases = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    sql = f"""
    __sized AS (
      SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM {docs}),
    __src AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
      FROM __sized GROUP BY source),
    __w AS (
      SELECT *, (CASE rk % {len(WEIGHTS)} {cases} END)::DOUBLE AS w, source_size * {CAP}::DOUBLE AS cap FROM __src),
    __lvl AS (
      SELECT *, cap / w AS ratio,
        (sum(source_size) OVER () * {SHARE}::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(w) OVER ()
          - coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lvl
      FROM __w),
    __share AS (
      SELECT (SELECT lvl FROM __lvl WHERE ratio > lvl ORDER BY ratio, rk LIMIT 1) AS s),
    __plan AS (
      SELECT source, source_size, CASE WHEN s IS NULL THEN cap ELSE least(cap, s * w) END AS target
      FROM __lvl, __share),
    __rate AS (
      SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM __plan),
    __drawn AS (
      SELECT d.*, p.source_size, p.target,
        (floor(rate) + CASE WHEN {u} < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies
      FROM __sized d JOIN __rate p ON d.source IS NOT DISTINCT FROM p.source)"""
    return sql, "__drawn"


def op2_sql() -> str:
    ctes, name = mix_sql()
    return (
        f"WITH {ctes} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM {name}"
    )
