"""Rows at given ranks of a global order, without gathering rows in one task.

One range shuffle puts the rows in order and they are written with their
places in their ranges.  Counts of the ranges (one number each) then tell in
which range, and where in it, a rank stands.
"""
from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from roadpulse.session import materialize


class Ranks:
    """``df``'s columns ``cols`` in order, nulls last.  Rows that are equal in
    all of ``cols`` can't be spread, so the last column should tell rows apart."""

    def __init__(self, df: DataFrame, *cols: str):
        order = [F.col(c).asc_nulls_last() for c in cols]
        self.rows = materialize(
            df.select(*cols).repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_spot", F.monotonically_increasing_id()), "ranks")
        counts = self.rows.groupBy(F.shiftright("_spot", 33).alias("range")).count().orderBy("range").collect()
        self._ranges = [r["range"] for r in counts]
        self._starts = [0, *accumulate(r["count"] for r in counts)]
        self.n = self._starts[-1]

    def at(self, ranks: list[int]) -> list[Row]:
        """The rows at some ranks (from 0)."""
        spots = []
        for r in ranks:
            k = bisect_right(self._starts, r) - 1
            spots.append((self._ranges[k] << 33) + r - self._starts[k])
        found = {r["_spot"]: r for r in self.rows.where(F.col("_spot").isin(spots)).collect()}
        return [found[s] for s in spots]
