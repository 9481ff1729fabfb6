"""Spatial context, precedents, corridor fallback, deployment
geometry and conflict detection - all as joins over the grid kNN."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.constants import (
    BARRICADE_RING_M, CONFLICT_RADIUS_M, CONTEXT_K, NEAREST_CORRIDORS_K, OFFICER_RING_M,
    SIMILAR_K, SIMILAR_MAX_KM, SIMILAR_MIN_SAME_CAUSE,
)
from roadpulse.functions.geo import (
    bearing_between, chord_for_km, haversine_km, neighbour_offsets, offset_point, unit_xyz,
)
from roadpulse.operators.knn import FEW, among_few, knn_join
from roadpulse.operators.living_history import LivingHistory
from roadpulse.operators.spatial_index import PointIndex
from roadpulse.session import materialize, scratch_path

SIMILAR_COLS = ["event_cause", "address", "corridor", "priority", "requires_road_closure",
                "duration_min", "duration_valid", "start_ts"]


CONTEXT_COLS = ["corridor", "police_station", "zone", "is_corridor"]


def history_index(history: DataFrame | PointIndex) -> PointIndex:
    """The history's index by cause: itself, or one written for this call."""
    if isinstance(history, PointIndex):
        return history
    held = history.select("id", "latitude", "longitude", *dict.fromkeys([*CONTEXT_COLS, *SIMILAR_COLS]))
    return PointIndex.build(held, scratch_path(history.sparkSession, f"history_{uuid.uuid4().hex[:12]}"), keys=("event_cause",))


def nearest_context(requests: DataFrame, history: DataFrame | PointIndex, k: int = CONTEXT_K) -> DataFrame:
    """Over the k nearest history rows, the most common corridor,
    station, zone and corridor flag (ties -> smallest), nearest distance and
    neighbour count."""
    nn = knn_join(requests.select("request_id", "lat", "lon"), history_index(history), k, columns=CONTEXT_COLS)
    return nn.groupBy("request_id").agg(
        F.mode("corridor", True).alias("corridor"),
        F.mode("police_station", True).alias("police_station"),
        F.mode("zone", True).alias("zone"),
        F.mode("is_corridor", True).cast("int").alias("is_corridor"),
        F.min("distance_km").alias("nearest_distance_km"),
        F.count("*").cast("int").alias("n_neighbors_used"),
    )


def similar_incidents(requests: DataFrame, history: DataFrame | PointIndex, k: int = SIMILAR_K,
                      max_km: float = SIMILAR_MAX_KM) -> DataFrame:
    """Precedents.  Candidates are the same cause when that cause has
    >= 3 rows in the whole history, else every cause; the k nearest within
    ``max_km`` (equal to "k nearest, then radius")."""
    index = history_index(history)
    cause_n = index.key_counts().withColumnRenamed("n", "_cause_n")  # exact far beyond 3
    req = materialize(requests.select("request_id", "lat", "lon", "event_cause").join(cause_n, "event_cause", "left"), "similar_asked")
    common = F.coalesce(F.col("_cause_n"), F.lit(0)) >= SIMILAR_MIN_SAME_CAUSE
    columns = ["id", "latitude", "longitude", *SIMILAR_COLS]
    same = knn_join(req.where(common).select("request_id", "lat", "lon", "event_cause"), index, k,
                    keys=("event_cause",), max_km=max_km, columns=columns)
    rare = req.where(~common).select("request_id", "lat", "lon")
    if not rare.isEmpty():
        same = same.unionByName(knn_join(rare, index, k, max_km=max_km, columns=columns))
    return same.withColumnRenamed("id", "hid")


def corridor_centroids(history: DataFrame | LivingHistory) -> DataFrame:
    """Mean position of every named corridor."""
    if isinstance(history, LivingHistory):
        return history.corridor_centroids()
    return (history.where(F.col("corridor") != "Non-corridor").groupBy("corridor")
            .agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")))


def nearest_corridors(requests: DataFrame, history: DataFrame | LivingHistory, exclude_col: str | None = None,
                      k: int = NEAREST_CORRIDORS_K) -> DataFrame:
    """The k nearest corridor centroids, skipping the request's own
    (closed) corridor when ``exclude_col`` names a non-empty value."""
    cents = corridor_centroids(history)
    cols = ["request_id", "lat", "lon"] + ([exclude_col] if exclude_col else [])
    req = requests.select(*cols)
    if exclude_col:
        req = materialize(req, "corridor_asked")  # read several times, and costly where it holds a context
        if cents.limit(FEW + 1).count() <= FEW and req.groupBy("request_id").count().where(F.col("count") > 1).isEmpty():
            nn = among_few(req.where(F.col("request_id").isNotNull()), cents, k, "request_id", "lat", "lon", "corridor",
                           "latitude", "longitude", (), None, skip=exclude_col)
            return nn.select("request_id", F.col("nn_rank").alias("route_rank"), "corridor", "latitude", "longitude", "distance_km")
    nn = knn_join(req, cents, k + 1, right_id="corridor")
    if exclude_col:
        nn = nn.join(req.select("request_id", F.col(exclude_col).alias("_excl")), "request_id")
        nn = nn.where(F.col("_excl").isNull() | (F.col("_excl") == "") | (F.col("corridor") != F.col("_excl")))
    w = Window.partitionBy("request_id").orderBy("distance_km", "corridor")
    return (nn.withColumn("route_rank", F.row_number().over(w)).where(F.col("route_rank") <= k)
            .select("request_id", "route_rank", "corridor", "latitude", "longitude", "distance_km"))


def _ring(n_col):
    return F.when(n_col > 0, F.sequence(F.lit(0), n_col - 1)).otherwise(F.array().cast("array<int>"))


def deployment_points(plan: DataFrame, lat: str = "lat", lon: str = "lon",
                      n_barricades: str = "barricade_points", n_personnel: str = "personnel",
                      barricade_m: float = BARRICADE_RING_M, officer_m: float = OFFICER_RING_M) -> DataFrame:
    """Barricades evenly on a ring from north; one officer at each
    barricade first, the rest evenly on a small ring (a single one due
    north).  Zero or negative counts give no points.  Long format:
    (request_id, kind, idx, bearing, lat, lon)."""
    nb = F.greatest(F.col(n_barricades), F.lit(0))
    npers = F.greatest(F.col(n_personnel), F.lit(0))
    base = plan.select("request_id", F.col(lat).alias("_lat"), F.col(lon).alias("_lon"),
                       nb.alias("_nb"), npers.alias("_np"))
    bar = base.select("request_id", "_lat", "_lon", "_nb", F.explode(_ring(F.col("_nb"))).alias("idx"))
    bar = bar.withColumn("bearing", F.lit(360.0) / F.col("_nb") * F.col("idx"))
    blat, blon = offset_point("_lat", "_lon", F.lit(barricade_m), "bearing")
    bar = bar.select("request_id", F.lit("barricade").alias("kind"), "idx", "bearing",
                     blat.alias("lat"), blon.alias("lon"))

    at_b = F.least(F.col("_np"), F.col("_nb"))
    off_b = base.select("request_id", "_lat", "_lon", "_nb",
                        F.explode(_ring(at_b)).alias("idx"))
    off_b = off_b.withColumn("bearing", F.lit(360.0) / F.col("_nb") * F.col("idx"))
    olat, olon = offset_point("_lat", "_lon", F.lit(barricade_m), "bearing")
    off_b = off_b.select("request_id", F.lit("officer").alias("kind"), "idx", "bearing",
                         olat.alias("lat"), olon.alias("lon"))

    rest = base.select("request_id", "_lat", "_lon", at_b.alias("_at"),
                       (F.col("_np") - at_b).alias("_r"))
    rest = rest.select("request_id", "_lat", "_lon", "_at", "_r", F.explode(_ring(F.col("_r"))).alias("_i"))
    rest = rest.withColumn("bearing", F.when(F.col("_r") > 1, F.lit(360.0) / F.col("_r") * F.col("_i"))
                           .otherwise(F.lit(0.0)))
    rlat, rlon = offset_point("_lat", "_lon", F.lit(officer_m), "bearing")
    rest = rest.select("request_id", F.lit("officer").alias("kind"), (F.col("_at") + F.col("_i")).alias("idx"),
                       "bearing", rlat.alias("lat"), rlon.alias("lon"))
    return bar.unionByName(off_b).unionByName(rest)


#: events of a cell that one task compares with a neighbour; a cell with more is dealt to several
CELL_SHARE = 2048


def detect_conflicts(register: DataFrame, radius_m: float = CONFLICT_RADIUS_M) -> DataFrame:
    """Pairs of active events closer than ``radius_m`` (strict), each pair
    once (id_a < id_b), as an equi-join on grid cells of that size.

    A cell meets itself and the half of its neighbours that come after it, and
    only those that hold events: the cells' counts, one small row each, are
    joined first.  A crowded cell's events are dealt to several tasks."""
    cell = chord_for_km(radius_m / 1000.0)
    x, y, z = unit_xyz("lat", "lon")
    act = register.where(F.col("status") == "active").select(
        "id", "lat", "lon", "personnel", x.alias("_x"), y.alias("_y"), z.alias("_z"))
    act = act.withColumns({f"_c{v}": F.floor(F.col(f"_{v}") / F.lit(cell)).cast("long") for v in "xyz"})
    act = materialize(act.where(F.col("_cx").isNotNull()), "conflicts_active")
    cells = act.groupBy("_cx", "_cy", "_cz").agg(F.ceil(F.count("*") / F.lit(CELL_SHARE)).alias("_shares"))
    # a cell and its later neighbours that hold events, with the shares of theirs
    later = F.filter(neighbour_offsets(), lambda o: (o["dx"] > 0) | ((o["dx"] == 0) & ((o["dy"] > 0) | ((o["dy"] == 0) & (o["dz"] >= 0)))))
    near = cells.select("_cx", "_cy", "_cz", F.explode(later).alias("_o")).select(
        "_cx", "_cy", "_cz", *[(F.col(f"_c{v}") + F.col(f"_o.d{v}")).alias(f"_n{v}") for v in "xyz"])
    near = near.join(cells.select(*[F.col(f"_c{v}").alias(f"_n{v}") for v in "xyz"], "_shares"), ["_nx", "_ny", "_nz"])
    a = act.join(near, ["_cx", "_cy", "_cz"]).select(
        *[F.col(c).alias(f"a_{c}") for c in ("id", "lat", "lon", "personnel", "_x", "_y", "_z", "_cx", "_cy", "_cz")], "_nx", "_ny", "_nz",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"))
    b = act.join(cells, ["_cx", "_cy", "_cz"]).select(
        *[F.col(c).alias(f"b_{c}") for c in ("id", "lat", "lon", "personnel", "_x", "_y", "_z")],
        *[F.col(f"_c{v}").alias(f"_n{v}") for v in "xyz"], F.pmod(F.xxhash64("id"), F.col("_shares")).alias("_share"))
    same = (F.col("a__cx") == F.col("_nx")) & (F.col("a__cy") == F.col("_ny")) & (F.col("a__cz") == F.col("_nz"))
    chord = sum(F.pow(F.col(f"a__{v}") - F.col(f"b__{v}"), 2) for v in "xyz")  # cheap, and never more than the arc
    pairs = a.join(b, ["_nx", "_ny", "_nz", "_share"]).where(
        (chord <= F.lit((cell + 1e-9) ** 2)) & (~same | (F.col("a_id") < F.col("b_id"))))
    dist_m = haversine_km("a_lat", "a_lon", "b_lat", "b_lon") * 1000.0
    return (pairs.withColumn("distance_m", dist_m).where(F.col("distance_m") < radius_m)
            .select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "distance_m",
                    (F.col("a_personnel") + F.col("b_personnel")).alias("combined_personnel")))
