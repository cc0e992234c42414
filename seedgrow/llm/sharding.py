"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash of each row.
It starts as one bucket; only a bucket over the byte limit splits on one more
bit, until every shard fits. A shard is therefore the shortest hash prefix
whose rows fit the limit.

The directory is built ``STEP`` bits at a time: one partial aggregate of
bytes per prefix (at most 2^STEP rows per open bucket), then the depth at
which each slot's bucket closes. Rows look their slot up by an equi-join on
the prefix; the first level has at most 2^STEP slots and is broadcast, later
levels hold only the slots of buckets that were still open.

What no bit can separate is rows with equal hashes, that is copies equal in
id and text. If such a bucket is over the limit it is cut into runs that fit,
``prefix/1``, ``prefix/2`` ..., numbered by a two-level count (per input split,
then over splits), so no task holds more than one split's copies. A single
row over the limit is a shard of its own: the only kind that exceeds it.

Edge cases: null text counts 0 bytes and hashes differently from ''; null ids
hash as 'null'; an empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedgrow.llm.common import Scratch, read_table

# Bits of the hash in use and bits resolved by one pass.
BITS = 60
STEP = 10
LIMIT_BYTES = 1 << 20


def row_hash():
    """60 bits of md5 over the id and the digest of the text."""
    key = F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null"))
    )
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def row_bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def _close_level(leaves: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Depth and totals at which each slot of depth ``high`` closes.

    ``leaves``: ``p`` (prefix of ``high`` bits), bytes, rows, lo, hi. Slots
    that stay open have a null ``depth``.
    """
    e = leaves.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high))))
    e = e.withColumn("q", F.expr(f"shiftright(p, {high} - d)"))
    # Partitioned by the slot's open parent too: at most 2^STEP rows each.
    w = Window.partitionBy(F.expr(f"shiftright(p, {high - low})"), "d", "q")
    e = e.select(
        "p", "d", "q",
        F.sum("bytes").over(w).alias("b"), F.sum("rows").over(w).alias("n"),
        F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"),
    )
    closed = F.when((F.col("b") <= limit) | (F.col("lo") == F.col("hi")), F.struct("d", "q", "b", "n", "lo", "hi"))
    s = e.groupBy("p").agg(F.min(closed).alias("s"))
    return s.select(
        "p", F.col("s.d").alias("depth"), F.col("s.q").alias("q"), F.col("s.b").alias("b"), F.col("s.n").alias("n"),
        ((F.col("s.b") > limit) & (F.col("s.n") > 1)).alias("twins"),
    )


def build_directory(keys: DataFrame, scratch: Scratch, limit: int) -> list[tuple[int, DataFrame]]:
    """Slot tables ``(bits, slots)`` of each level, coarse to fine.

    ``keys``: ``h`` and ``bytes`` of every row. The loop runs once per
    ``STEP`` bits of the deepest bucket, at most BITS / STEP times.
    """
    levels: list[tuple[int, DataFrame]] = []
    low, rows = 0, keys
    while low < BITS:
        high = low + STEP
        p = F.shiftright("h", BITS - high)
        leaves = rows.groupBy(p.alias("p")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"),
            F.min("h").alias("lo"), F.max("h").alias("hi"),
        )
        slots = scratch.keep(_close_level(leaves, low, high, limit), f"slots{high}")
        levels.append((high, slots.where(F.col("depth").isNotNull())))
        still = slots.where(F.col("depth").isNull()).select(F.col("p").alias("o"))
        if still.isEmpty():
            break
        rows = rows.join(still, F.shiftright(rows["h"], BITS - high) == still["o"], "left_semi")
        low = high
    return levels


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` plus ``shard, depth, doc_bytes, shard_bytes``.

    ``shard`` is the bucket's hash prefix in bits ('' is the whole table),
    with ``/k`` for the k-th run of inseparable copies.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    scratch = Scratch(docs.sparkSession, "shard")
    keys = scratch.keep(docs.select(row_hash().alias("h"), row_bytes().alias("bytes")), "keys")
    levels = build_directory(keys, scratch, limit)
    rows = docs.withColumns({"__sg_h": row_hash(), "doc_bytes": row_bytes()})
    slot = F.lit(None).cast("struct<depth:int,q:bigint,b:bigint,twins:boolean>")
    rows = rows.withColumn("__sg_slot", slot)
    for high, slots in levels:
        s = slots.select(F.col("p").alias("__sg_p"), F.struct("depth", "q", "b", "twins").alias("__sg_new"))
        if high == STEP:
            s = F.broadcast(s)  # at most 2^STEP rows
        # A row that has its slot gets a negative key: it matches nothing and spreads evenly.
        k = F.when(F.col("__sg_slot").isNull(), F.shiftright("__sg_h", BITS - high)).otherwise(-1 - F.col("__sg_h"))
        rows = rows.join(s, k == s["__sg_p"], "left")
        rows = rows.withColumn("__sg_slot", F.coalesce("__sg_slot", "__sg_new")).drop("__sg_p", "__sg_new")
    depth, q = F.col("__sg_slot.depth"), F.col("__sg_slot.q")
    bits = F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(q.cast("string"), 10, 2), depth, F.lit("0")))
    rows = rows.withColumns({"shard": bits, "depth": depth, "shard_bytes": F.col("__sg_slot.b")})
    twin = F.col("__sg_slot.twins")
    if all(s.where("twins").isEmpty() for _, s in levels):
        return rows.drop("__sg_slot", "__sg_h")
    cut = _cut_twins(scratch, rows.where(twin), limit).drop("__sg_slot", "__sg_h")
    return rows.where(~twin).drop("__sg_slot", "__sg_h").unionByName(cut)


def _cut_twins(scratch: Scratch, twins: DataFrame, limit: int) -> DataFrame:
    """Cut buckets of equal rows into runs of at most ``limit`` bytes."""
    t = scratch.keep(twins.withColumn("__sg_i", F.monotonically_increasing_id()), "twins")
    t = t.withColumn("__sg_split", F.shiftright("__sg_i", 33))
    counts = t.groupBy("__sg_h", "__sg_split").agg(F.count(F.lit(1)).alias("__sg_n"))
    before = Window.partitionBy("__sg_h").orderBy("__sg_split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "__sg_h", "__sg_split", F.coalesce(F.sum("__sg_n").over(before), F.lit(0)).alias("__sg_before")
    )
    t = t.join(counts, ["__sg_h", "__sg_split"])
    place = F.col("__sg_before") + F.row_number().over(Window.partitionBy("__sg_h", "__sg_split").orderBy("__sg_i")) - 1
    per = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("doc_bytes"), F.lit(1))), F.lit(1))
    t = t.withColumns({"__sg_per": per, "__sg_place": place})
    run = F.floor(F.col("__sg_place") / F.col("__sg_per"))
    total = F.floor(F.col("shard_bytes") / F.greatest(F.col("doc_bytes"), F.lit(1)))
    in_run = F.least(F.col("__sg_per"), total - run * F.col("__sg_per"))
    t = t.withColumns(
        {
            "shard": F.concat_ws("/", "shard", (run + 1).cast("string")),
            "shard_bytes": (in_run * F.col("doc_bytes")).cast("long"),
        }
    )
    return t.drop("__sg_i", "__sg_split", "__sg_before", "__sg_per", "__sg_place")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write each shard as one folder ``shard=<prefix>`` of parquet files."""
    out = assign_shards(docs, limit).withColumn("shard", F.concat(F.lit("s"), F.translate("shard", "/", "_")))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def op3_shard(spark, sf_dir: str) -> DataFrame:
    d = assign_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "doc_bytes", "shard", "depth", "shard_bytes")


def op3_sql() -> str:
    deepest = 40
    return f"""
    WITH k AS (
      SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS doc_bytes,
        ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')),
                        1, {BITS // 4}))::BIGINT AS h
      FROM documents),
    e AS (SELECT *, d, h >> ({BITS} - d) AS q FROM k, range(0, {deepest + 1}) AS r(d)),
    t AS (SELECT d, q, sum(doc_bytes)::BIGINT AS b, min(h) AS lo, max(h) AS hi FROM e GROUP BY d, q),
    c AS (
      SELECT e.*, t.b, row_number() OVER (PARTITION BY e.doc_id, e.h ORDER BY e.d) AS rn
      FROM e JOIN t ON e.d = t.d AND e.q = t.q WHERE t.b <= {LIMIT_BYTES} OR t.lo = t.hi)
    SELECT doc_id, doc_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(q), CAST(d AS INTEGER), '0') END AS shard,
      CAST(d AS INTEGER) AS depth, b AS shard_bytes
    FROM c WHERE rn = 1"""
