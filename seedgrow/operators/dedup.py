"""First-copy flag for duplicated feature vectors (``features`` match mode).

The original's ``except`` de-duplicates the pool by vector. The loops keep
one row per vector by flagging, once, the copy with the smallest id:

1. ``groupBy(digest of the vector).agg(min(id))`` — partial aggregation on the map side,
   so a vector repeated across a third of the table costs one row per map
   task, not one task holding a third of the rows (a window partitioned by
   the vector would);
2. left join of the rows with those representatives on (id, digest), so
   that rows sharing an id by mistake neither multiply nor flag each other.

The digest has 128 bits; the job fails if two vectors ever share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedgrow.functions.vectors import DIGEST, as_array, vector_digest
from seedgrow.operators.setops import distinct_vectors


def mark_first_copies(
    df: DataFrame, id_col: str = "row_id", features_col: str = "features", out_col: str = "is_first"
) -> DataFrame:
    own = df.withColumns(dict(zip(DIGEST, vector_digest(as_array(features_col)))))
    reps = distinct_vectors(df, id_col, features_col).select(
        *[F.col(c).alias(f"{c}_rep") for c in DIGEST], F.col("rep_id").alias("__rep"), F.col("vec").isNotNull().alias("__is_rep")
    )
    on = own[id_col].eqNullSafe(reps["__rep"])
    for c in DIGEST:
        on = on & (own[c] == reps[f"{c}_rep"])
    joined = own.join(reps, on, "left")
    flag = F.coalesce(F.col("__is_rep"), F.lit(False))
    return joined.withColumn(out_col, flag).drop("__rep", "__is_rep", *DIGEST, *[f"{c}_rep" for c in DIGEST])


def duplicate_summary(df: DataFrame, id_col: str = "row_id", features_col: str = "features") -> DataFrame:
    """``(n_rows, n_distinct)`` for a table of vectors."""
    flagged = mark_first_copies(df, id_col, features_col)
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("is_first").cast("long")).alias("n_distinct"),
    )
