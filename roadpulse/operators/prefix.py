"""Running sums over an order, spread over many tasks.

A window's running sum puts a whole group into one task; a group may hold most
of the table.  Here one range shuffle cuts the ordered rows into ranges, which
may end inside a group.  The sums of each (range, group) are small; their
running sums over the ranges are the offsets that each range's own running sum
starts from.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.session import materialize


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, str],
                 totals: dict[str, str] | None = None, name: str = "running") -> DataFrame:
    """``df`` with, for each ``new: column`` of ``sums``, the column's sum over
    the rows of its group that come before in ``order`` (0 for the first), and
    for each of ``totals`` the sum over the whole group.

    ``order`` should tell all rows apart: rows that are equal in group and
    order can't be spread, and which of them comes first is left open.  NULL
    groups are a group; NULL values add nothing.  Rows are written once."""
    keys = [F.col(g) for g in group]
    ranged = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), name)
    columns = sorted({*sums.values(), *(totals or {}).values()})
    # one row for each range and group in it: as many as ranges and groups together, at most
    parts = ranged.groupBy("_range", *group).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{c}") for c in columns])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = parts.select(
        F.col("_range").alias("_offset_range"), *[F.col(g).alias(f"_offset_{g}") for g in group],
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{n}") for n, c in sums.items()],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"_total_{n}") for n, c in (totals or {}).items()])
    same = F.col("_range") == F.col("_offset_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_offset_{g}"))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums],
        *[F.col(f"_total_{n}").alias(n) for n in (totals or {})])
