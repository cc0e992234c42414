"""Deterministic per-row uniform numbers.

``randomSplit`` depends on partitioning (the same rows split differently
when the input is re-partitioned), so splits here are a pure function of
(seed, row id): the first 32 bits of ``md5('<seed>:<id>')`` scaled to
[0, 1). No shuffle, stable under recomputation after executor loss, and
nested in the fraction (a row labelled at p stays labelled at p' > p).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def unit_hash(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(F.lit(f"{int(seed)}:"), c.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)


def unit_hash_sql(id_sql: str, seed: int) -> str:
    """The same number in DuckDB SQL (used by the oracles)."""
    return (
        f"(('0x' || substr(md5('{int(seed)}:' || CAST({id_sql} AS VARCHAR)), 1, 8))"
        f"::UBIGINT / {_TWO_32})"
    )
