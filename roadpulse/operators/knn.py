"""Exact k-nearest-neighbour join.

The right side is a stored ``PointIndex``, or a table, for which an index is
written first.  A table of very few rows, as of corridor centroids, is counted
and then goes to every task as one array.  No cross join, no broadcast of
anything that is not counted.  Ties are broken by the right-side id.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.functions.geo import haversine_km
from roadpulse.operators.spatial_index import PointIndex
from roadpulse.session import scratch_path

#: right rows up to which they are sent to every task
FEW = 64


def among_few(left: DataFrame, right: DataFrame, k: int, left_id, left_lat, left_lon, right_id, right_lat, right_lon,
              keys, max_km, skip: str | None = None) -> DataFrame:
    """Each left row against one array of all right rows (at most ``FEW``).
    ``skip`` is a left column that names a right id to leave out, if not NULL or empty."""
    held = right.where(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull()).agg(
        F.collect_list(F.struct(*right.columns)).alias("_held"))
    rows = left.where(F.col(left_lat).isNotNull() & F.col(left_lon).isNotNull()).join(F.broadcast(held), how="cross")  # one row

    def away(p):
        return F.struct(haversine_km(left_lat, left_lon, p[right_lat], p[right_lon]).alias("distance_km"),
                        p[right_id].alias("id"), p.alias("row"))

    near = F.col("_held")
    for key in keys:
        near = F.filter(near, lambda p, key=key: p[key] == F.col(key))
    if skip is not None:
        near = F.filter(near, lambda p: F.col(skip).isNull() | (F.col(skip) == "") | (p[right_id] != F.col(skip)))
    near = F.transform(near, away)
    if max_km is not None:
        near = F.filter(near, lambda p: p["distance_km"] <= max_km)
    best = F.slice(F.array_sort(near), 1, k)
    out = rows.select(F.col(left_id), F.posexplode(best).alias("_rank", "_best"))
    return out.select(left_id, *[F.col("_best.row")[c].alias(c) for c in right.columns], F.col("_best.distance_km").alias("distance_km"),
                      (F.col("_rank") + 1).alias("nn_rank"))


def knn_join(left: DataFrame, right: DataFrame | PointIndex, k: int, *,
             left_id: str = "request_id", left_lat: str = "lat", left_lon: str = "lon",
             right_id: str = "id", right_lat: str = "latitude", right_lon: str = "longitude",
             keys: tuple[str, ...] = (), max_km: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """For each left row, the k nearest right rows (sharing ``keys``), or
    with ``max_km`` the k nearest within that radius.  k is capped at the
    number of right rows with the same keys.

    Returns ``left_id``, every right column (of an index: ``columns``),
    ``distance_km`` and ``nn_rank`` (1 = nearest).  Rows without coordinates
    have no neighbours and are nobody's.
    """
    if not isinstance(right, PointIndex):
        if left.isEmpty():  # nothing to place: write no index
            return left.sparkSession.createDataFrame([], T.StructType([
                left.schema[left_id], *right.schema.fields, T.StructField("distance_km", T.DoubleType()),
                T.StructField("nn_rank", T.IntegerType())]))
        if right.limit(FEW + 1).count() <= FEW:
            return among_few(left, right, k, left_id, left_lat, left_lon, right_id, right_lat, right_lon, keys, max_km)
        right = PointIndex.build(right, scratch_path(right.sparkSession, f"knn_{uuid.uuid4().hex[:12]}"),
                                 id=right_id, lat=right_lat, lon=right_lon, keys=keys)
    return right.knn(left, k, left_id=left_id, left_lat=left_lat, left_lon=left_lon, by_keys=bool(keys), max_km=max_km, columns=columns)
