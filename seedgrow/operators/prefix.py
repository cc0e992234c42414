"""Running sums and positions over a whole table, in two levels.

A window ordered over a whole table would put every row in one task. Here the
rows are dealt into ordered ranges by ``repartitionByRange`` and written once
with the number of their range. Each range's totals (one row a range and
group) get their running sums by a window over that small written table, and a
join brings them back; a window inside each range finishes the sums. The planner
picks the join from the written sizes. The result does not depend on where
the ranges are cut, so neither bounds nor counts pass through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from seedgrow.plans.lineage import Workspace

RANGE = "__range"


def _order(columns: Sequence[str], descending: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() if c in descending else F.col(c).asc() for c in columns]


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[f"__{c}"])
    return on


def running_sums(
    df: DataFrame,
    ws: Workspace,
    rel: str,
    order: Sequence[str],
    sums: Sequence[str],
    groups: Sequence[str] = (),
    descending: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """``df`` with ``<c>_before`` and ``<c>_total`` for every ``c`` of ``sums``: the
    sum over the rows of the same ``groups`` that come earlier in ``order``, and over
    all of them. ``order`` must be unique inside a group. ``df`` is evaluated once;
    its rows stay under ``rel`` of the workspace. ``ranges`` fixes their number,
    for tests; otherwise the session's shuffle settings decide."""
    by = [*[F.col(g) for g in groups], *_order(order, descending)]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    ws.write(dealt.withColumn(RANGE, F.spark_partition_id()), rel)
    schema = df.withColumn(RANGE, F.lit(0)).schema
    rows = ws.read(rel, schema)
    totals = rows.groupBy(*groups, RANGE).agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    keys = [*groups, RANGE]
    offsets = totals.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}_offset") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
    )
    ws.write(offsets, f"{rel}-offsets")
    offsets = ws.read(f"{rel}-offsets", offsets.schema)
    j = rows.join(offsets, _same(rows, offsets, keys))
    inside = Window.partitionBy(*keys).orderBy(*_order(order, descending)).rowsBetween(Window.unboundedPreceding, -1)
    out = j.select(
        *[rows[c] for c in df.columns],
        *[(F.col(f"__{c}_offset") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
    )
    return out


def positions(df: DataFrame, ws: Workspace, rel: str, order: Sequence[str], descending: Sequence[str] = (),
              out: str = "position", ranges: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in ``order`` (unique)."""
    one = "__one"
    d = running_sums(df.withColumn(one, F.lit(1).cast("long")), ws, rel, order, [one], (), descending, ranges)
    return d.withColumn(out, F.col(f"{one}_before")).drop(one, f"{one}_before", f"{one}_total")
