"""The query catalog: every registered query as (spark builder, oracle SQL).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the parquet tables of ``sf_dir`` (through the fixtures).  The oracle text,
when present, computes the same rows on DuckDB.
"""
from __future__ import annotations

import hashlib
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions import geo as G
from roadpulse.functions import temporal as T
from roadpulse.functions.text import cause_title, prettify
from roadpulse.operators import cleaning, dashboards, places
from roadpulse.operators.living_history import LivingHistory
from roadpulse.plans.oracle import (
    CLEAN_SQL, PROCESSED_SQL, RAW_PARSED_SQL, _r, processed_ctes, with_ctes,
)
from roadpulse.session import materialize, scratch_path
from roadpulse.sources import fixtures as FX
from roadpulse.sources.incidents import load_incidents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ------------------------------------------------------------------ inputs
def incidents(spark, sf_dir) -> DataFrame:
    return FX.fixture(spark, sf_dir, "incidents")


def processed(spark, sf_dir) -> DataFrame:
    return cleaning.prepare_incidents(incidents(spark, sf_dir))


def stored_history(spark, sf_dir) -> LivingHistory:
    """The processed incidents as a stored history, written once per input
    directory in the shared scratch folder."""
    path = scratch_path(spark, f"history_v1_{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}")
    history = LivingHistory(spark, path)
    return history if history.version else LivingHistory.create(processed(spark, sf_dir), path)


def raw_csv_path(spark: SparkSession, sf_dir: str) -> str:
    """Land the text export as CSV (with two surplus columns) once per input
    directory, in the shared scratch folder."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    path = scratch_path(spark, f"incidents_raw_csv_v3_{tag}")
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        # keep surrounding blanks: they are part of the raw values (" debris ")
        (FX.fixture(spark, sf_dir, "incidents_raw").write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def raw_incidents(spark, sf_dir) -> DataFrame:
    return load_incidents(spark, raw_csv_path(spark, sf_dir))


# ------------------------------------------------------- A: sources / sinks
@register("load_incidents", with_ctes(["incidents_raw"]) +
          """SELECT * EXCLUDE (comment, map_file) REPLACE (CASE WHEN zone NOT IN ('NULL', 'NA') THEN zone END AS zone)
FROM incidents_raw""")
def q_load_incidents(spark, sf_dir):
    return raw_incidents(spark, sf_dir)


@register("processed_from_raw", with_ctes(["incidents_raw"], {"incidents": RAW_PARSED_SQL, "processed": PROCESSED_SQL}) +
          f"""SELECT id, event_cause, event_type, priority, requires_road_closure, latitude, start_ts,
  hour, dow, month, daypart, is_festival_window, {_r('duration_min')} AS duration_min, duration_valid,
  corridor, is_corridor FROM processed""")
def q_processed_from_raw(spark, sf_dir):
    p = cleaning.prepare_incidents(raw_incidents(spark, sf_dir))
    return p.select("id", "event_cause", "event_type", "priority", "requires_road_closure", "latitude",
                    "start_ts", "hour", "dow", "month", "daypart", "is_festival_window",
                    F.round("duration_min", 6).alias("duration_min"), "duration_valid", "corridor", "is_corridor")


# --------------------------------------------------- B: scalar functions
@register("clean_categoricals", with_ctes(["incidents"]) +
          f"""SELECT id, event_cause, event_type, priority, police_station, zone, requires_road_closure
FROM ({CLEAN_SQL}) c""")
def q_clean_categoricals(spark, sf_dir):
    return cleaning.clean_categoricals(incidents(spark, sf_dir)).select(
        "id", "event_cause", "event_type", "priority", "police_station", "zone", "requires_road_closure")


@register("parse_mixed_ts", with_ctes(["incidents_raw"]) +
          """SELECT id, TRY_CAST(start_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS start_utc,
  TRY_CAST(resolved_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS resolved_utc FROM incidents_raw""")
def q_parse_mixed_ts(spark, sf_dir):
    raw = raw_incidents(spark, sf_dir)
    return raw.select("id", T.parse_mixed_ts("start_datetime").alias("start_utc"),
                      T.parse_mixed_ts("resolved_datetime").alias("resolved_utc"))


@register("calendar_features", processed_ctes() +
          "SELECT id, start_ts, hour, dow, dow_name, month, is_weekend FROM processed")
def q_calendar(spark, sf_dir):
    return processed(spark, sf_dir).select("id", "start_ts", "hour", "dow", "dow_name", "month", "is_weekend")


@register("cyclical_features", processed_ctes() +
          f"SELECT id, {_r('hour_sin')} AS hour_sin, {_r('hour_cos')} AS hour_cos, "
          f"{_r('dow_sin')} AS dow_sin, {_r('dow_cos')} AS dow_cos FROM processed")
def q_cyclical(spark, sf_dir):
    p = processed(spark, sf_dir)
    return p.select("id", *[F.round(c, 6).alias(c) for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")])


@register("daypart", processed_ctes() + "SELECT id, hour, daypart FROM processed")
def q_daypart(spark, sf_dir):
    return processed(spark, sf_dir).select("id", "hour", "daypart")


@register("festival_flag", processed_ctes() +
          "SELECT id, CAST(start_ts AS DATE) AS local_date, is_festival_window FROM processed")
def q_festival(spark, sf_dir):
    return processed(spark, sf_dir).select("id", F.to_date("start_ts").alias("local_date"), "is_festival_window")


@register("duration_features", processed_ctes() +
          f"SELECT id, {_r('duration_min')} AS duration_min, duration_valid FROM processed")
def q_duration(spark, sf_dir):
    return processed(spark, sf_dir).select("id", F.round("duration_min", 6).alias("duration_min"), "duration_valid")


@register("corridor_features", processed_ctes() + "SELECT id, corridor, is_corridor FROM processed")
def q_corridor(spark, sf_dir):
    return processed(spark, sf_dir).select("id", "corridor", "is_corridor")


@register("drop_unusable", with_ctes(["incidents_raw"], {"incidents": RAW_PARSED_SQL, "processed": PROCESSED_SQL}) +
          "SELECT id FROM processed")
def q_drop_unusable(spark, sf_dir):
    return cleaning.prepare_incidents(raw_incidents(spark, sf_dir)).select("id")


_TIER_SQL = """CASE WHEN {m} IS NULL OR isnan({m}) OR {m} < 0 THEN NULL WHEN {m} < 30 THEN 'Quick (<30 min)'
  WHEN {m} < 120 THEN 'Moderate (30-120 min)' ELSE 'Prolonged (>120 min)' END"""


@register("duration_tier", processed_ctes() +
          f"SELECT id, {_r('duration_min')} AS duration_min, {_TIER_SQL.format(m='duration_min')} AS tier "
          "FROM processed")
def q_duration_tier(spark, sf_dir):
    p = processed(spark, sf_dir)
    return p.select("id", F.round("duration_min", 6).alias("duration_min"), T.duration_tier("duration_min").alias("tier"))


@register("prettify_junctions", processed_ctes() +
          r"""SELECT junction, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(junction, '([A-Z])', ' \1', 'g'),
  '\s+', ' ', 'g')), '\s+', ' ', 'g'), '\bJunc\b', 'Junction', 'g') AS pretty
FROM (SELECT DISTINCT junction FROM processed WHERE junction IS NOT NULL) j""")
def q_prettify(spark, sf_dir):
    j = processed(spark, sf_dir).where(F.col("junction").isNotNull()).select("junction").distinct()
    return j.select("junction", prettify("junction").alias("pretty"))


_CENTER = (12.9716, 77.5946)

_BEARING_SQL = """(degrees(atan2(sin(radians(longitude - {lon})) * cos(radians(latitude)),
  cos(radians({lat})) * sin(radians(latitude)) - sin(radians({lat})) * cos(radians(latitude)) * cos(radians(longitude - {lon}))))
  + 360e0) % 360e0""".format(lat=f"{_CENTER[0]}e0", lon=f"{_CENTER[1]}e0")


@register("compass_dir", processed_ctes() +
          f"""SELECT id, {_r('b')} AS bearing,
  (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor((b + 22.5e0) / 45e0) AS BIGINT) % 8 + 1] AS compass
FROM (SELECT id, {_BEARING_SQL} AS b FROM processed) t""")
def q_compass(spark, sf_dir):
    """Bearing and compass point of every incident as seen from the city centre."""
    p = processed(spark, sf_dir)
    b = G.bearing_between(F.lit(_CENTER[0]), F.lit(_CENTER[1]), "latitude", "longitude")
    return p.select("id", b.alias("b")).select("id", F.round("b", 6).alias("bearing"), G.compass_dir("b").alias("compass"))


@register("cause_title", processed_ctes() +
          """SELECT event_cause, array_to_string(list_transform(chars, lambda ch, i:
    CASE WHEN i = 1 OR NOT regexp_full_match(chars[i - 1], '[[:alpha:]]') THEN upper(ch) ELSE lower(ch) END), '') AS title
FROM (SELECT event_cause, string_split(replace(event_cause, '_', ' '), '') AS chars
      FROM (SELECT DISTINCT event_cause FROM processed) d) t""")
def q_cause_title(spark, sf_dir):
    c = processed(spark, sf_dir).select("event_cause").distinct()
    return c.select("event_cause", cause_title("event_cause").alias("title"))


# ---------------------------------------------------------- D: dashboards
@register("history_kpis", processed_ctes() +
          """SELECT count(*) AS events, avg(CAST(requires_road_closure AS DOUBLE)) * 100 AS closure_pct,
  avg(CAST(event_type = 'planned' AS DOUBLE)) * 100 AS planned_pct,
  (SELECT quantile_cont(duration_min, 0.5) FROM processed WHERE duration_valid) AS median_duration_min
FROM processed""")
def q_history_kpis(spark, sf_dir):
    return dashboards.history_kpis(processed(spark, sf_dir))


HOURLY_RISK_DOW = 2  # Wednesday: the reference uses "today"; fixed for reproducibility


@register("hourly_risk", processed_ctes() + f"""SELECT CAST(hour AS INT) AS hour,
  CASE WHEN (SELECT count(*) FROM processed WHERE dow = {HOURLY_RISK_DOW}) > 0
       THEN CAST(sum(CASE WHEN dow = {HOURLY_RISK_DOW} THEN 1 ELSE 0 END) AS DOUBLE)
       ELSE count(*) / (SELECT count(DISTINCT dow) FROM processed) END AS incidents
FROM processed GROUP BY hour""")
def q_hourly_risk(spark, sf_dir):
    return dashboards.hourly_risk(processed(spark, sf_dir), HOURLY_RISK_DOW)


_HEAT_COLS = ", ".join(f"count(CASE WHEN hour = {h} THEN id END) AS h{h:02d}" for h in range(24))


@register("dow_hour_heatmap", processed_ctes() + f"""SELECT d.day_order, d.dow_name, {', '.join(f'h.h{h:02d}' for h in range(24))}
FROM (SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
  (5, 'Saturday'), (6, 'Sunday')) v(day_order, dow_name)) d
LEFT JOIN (SELECT dow_name, {_HEAT_COLS} FROM processed GROUP BY dow_name) h ON d.dow_name = h.dow_name""")
def q_heatmap(spark, sf_dir):
    return dashboards.dow_hour_heatmap(processed(spark, sf_dir))


@register("cause_counts", processed_ctes() + "SELECT event_cause, count(*) AS n FROM processed GROUP BY event_cause")
def q_cause_counts(spark, sf_dir):
    return dashboards.cause_counts(processed(spark, sf_dir))


@register("top_risk_corridors", processed_ctes() + """SELECT corridor, round(rate * 100, 1) AS closure_rate, n_events FROM (
  SELECT corridor, avg(CAST(requires_road_closure AS DOUBLE)) AS rate, count(*) AS n_events
  FROM processed WHERE corridor <> 'Non-corridor' GROUP BY corridor HAVING count(*) >= 20
  ORDER BY rate DESC, corridor LIMIT 10) t""")
def q_top_risk_corridors(spark, sf_dir):
    return dashboards.top_risk_corridors(processed(spark, sf_dir))


@register("known_hotspots", processed_ctes() + r"""SELECT
  regexp_replace(trim(regexp_replace(regexp_replace(junction, '([A-Z])', ' \1', 'g'), '\s+', ' ', 'g')),
    '\bJunc\b', 'Junction', 'g') AS hotspot, junction, lat, lon, n FROM (
  SELECT junction, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS n FROM processed
  WHERE junction IS NOT NULL GROUP BY junction ORDER BY n DESC, junction LIMIT 14) t""")
def q_known_hotspots(spark, sf_dir):
    return dashboards.known_hotspots(processed(spark, sf_dir))


@register("map_sample", processed_ctes() + """SELECT id, latitude, longitude, event_cause, corridor, priority,
  requires_road_closure FROM processed ORDER BY md5(id), id LIMIT 4000""")
def q_map_sample(spark, sf_dir):
    return dashboards.map_sample(processed(spark, sf_dir))


@register("priority_corridor_determinism", processed_ctes() + """SELECT count(*) AS n,
  sum(CAST(priority = CASE WHEN is_corridor = 1 THEN 'High' ELSE 'Low' END AS INT)) AS n_match,
  avg(CAST(priority = CASE WHEN is_corridor = 1 THEN 'High' ELSE 'Low' END AS DOUBLE)) AS share_match,
  count(CASE WHEN is_corridor = 1 AND priority = 'High' THEN 1 END) AS corridor_high,
  count(CASE WHEN is_corridor = 1 AND priority <> 'High' THEN 1 END) AS corridor_other,
  count(CASE WHEN is_corridor = 0 AND priority = 'High' THEN 1 END) AS noncorridor_high,
  count(CASE WHEN is_corridor = 0 AND priority <> 'High' THEN 1 END) AS noncorridor_other
FROM processed""")
def q_priority_det(spark, sf_dir):
    return dashboards.priority_corridor_determinism(processed(spark, sf_dir))


@register("closure_rate_by_cause", processed_ctes() + """SELECT event_cause, count(*) AS n,
  avg(CAST(requires_road_closure AS DOUBLE)) AS closure_rate FROM processed GROUP BY event_cause""")
def q_closure_by_cause(spark, sf_dir):
    return dashboards.closure_rate_by_cause(processed(spark, sf_dir))


_RAW_COLS = ["id", "event_type", "latitude", "longitude", "address", "event_cause", "requires_road_closure",
             "start_datetime", "end_datetime", "status", "priority", "corridor", "created_date",
             "police_station", "closed_datetime", "resolved_datetime", "zone", "junction"]


@register("missingness_profile", with_ctes(["incidents_raw"]) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 1e0 - count(CASE WHEN {c} NOT IN ('NULL', 'NA') THEN 1 END) / count(*) AS null_fraction "
    "FROM incidents_raw"
    for c in _RAW_COLS))
def q_missingness(spark, sf_dir):
    return dashboards.missingness_profile(raw_incidents(spark, sf_dir))


@register("bbox", processed_ctes() + """SELECT min(longitude) - 6e-2 AS west, max(latitude) + 6e-2 AS north,
  max(longitude) + 6e-2 AS east, min(latitude) - 6e-2 AS south FROM processed""")
def q_bbox(spark, sf_dir):
    return dashboards.bbox(processed(spark, sf_dir))


# ---------------------------------------------------------------- C: spatial
from roadpulse.operators import spatial  # noqa: E402
from roadpulse.operators.knn import knn_join  # noqa: E402
from roadpulse.plans.oracle import CONTEXT_SQL, KNN5_SQL, SIMILAR_SQL, hav_sql  # noqa: E402


def requests_df(spark, sf_dir) -> DataFrame:
    return FX.fixture(spark, sf_dir, "requests")


def register_df(spark, sf_dir) -> DataFrame:
    return FX.fixture(spark, sf_dir, "register")


@register("haversine_km", processed_ctes() + f"""SELECT id,
  round({hav_sql('12.9716e0', '77.5946e0', 'latitude', 'longitude')}, 6) AS distance_km FROM processed""")
def q_haversine(spark, sf_dir):
    """Distance of every incident from the city centre."""
    p = processed(spark, sf_dir)
    return p.select("id", F.round(G.haversine_km(F.lit(12.9716), F.lit(77.5946), "latitude", "longitude"), 6)
                    .alias("distance_km"))


@register("grid_knn", processed_ctes("requests", extra={"knn5": KNN5_SQL}) +
          """SELECT request_id, hid, round(distance_km, 6) AS distance_km,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance_km, hid) AS INT) AS nn_rank FROM knn5""")
def q_grid_knn(spark, sf_dir):
    """Five nearest history incidents of every request (grid join)."""
    hist = processed(spark, sf_dir).select(F.col("id").alias("hid"), "latitude", "longitude")
    nn = knn_join(requests_df(spark, sf_dir).select("request_id", "lat", "lon"), hist, 5, right_id="hid")
    return nn.select("request_id", "hid", F.round("distance_km", 6).alias("distance_km"),
                     F.col("nn_rank").cast("int").alias("nn_rank"))


@register("nearest_context", processed_ctes("requests", extra={"knn5": KNN5_SQL}) +
          f"SELECT request_id, corridor, police_station, zone, is_corridor, round(nearest_distance_km, 6) "
          f"AS nearest_distance_km, n_neighbors_used FROM ({CONTEXT_SQL}) c")
def q_nearest_context(spark, sf_dir):
    ctx = spatial.nearest_context(requests_df(spark, sf_dir), stored_history(spark, sf_dir))
    return ctx.withColumn("nearest_distance_km", F.round("nearest_distance_km", 6))


@register("similar_incidents", processed_ctes("requests", extra={"sim8": SIMILAR_SQL}) +
          """SELECT request_id, hid, event_cause, corridor, round(duration_min, 6) AS duration_min, duration_valid,
  requires_road_closure, start_ts, round(distance_km, 6) AS distance_km,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance_km, hid) AS INT) AS nn_rank
FROM sim8 WHERE distance_km <= 5e0""")
def q_similar(spark, sf_dir):
    s = spatial.similar_incidents(requests_df(spark, sf_dir), stored_history(spark, sf_dir))
    return s.select("request_id", "hid", "event_cause", "corridor", F.round("duration_min", 6).alias("duration_min"),
                    "duration_valid", "requires_road_closure", "start_ts",
                    F.round("distance_km", 6).alias("distance_km"), F.col("nn_rank").cast("int").alias("nn_rank"))


@register("corridor_centroids", processed_ctes() + """SELECT corridor, avg(latitude) AS latitude,
  avg(longitude) AS longitude FROM processed WHERE corridor <> 'Non-corridor' GROUP BY corridor""")
def q_centroids(spark, sf_dir):
    return spatial.corridor_centroids(processed(spark, sf_dir))


NEAREST_CORRIDORS_SQL = f"""SELECT request_id, CAST(route_rank AS INT) AS route_rank, corridor, latitude, longitude,
  round(distance_km, 6) AS distance_km FROM (
  SELECT r.request_id, c.corridor, c.latitude, c.longitude,
    {hav_sql('r.lat', 'r.lon', 'c.latitude', 'c.longitude')} AS distance_km,
    row_number() OVER (PARTITION BY r.request_id ORDER BY
      {hav_sql('r.lat', 'r.lon', 'c.latitude', 'c.longitude')}, c.corridor) AS route_rank
  FROM requests r JOIN ctx ON ctx.request_id = r.request_id
  JOIN (SELECT corridor, avg(latitude) AS latitude, avg(longitude) AS longitude FROM processed
        WHERE corridor <> 'Non-corridor' GROUP BY corridor) c
    ON ctx.corridor IS NULL OR ctx.corridor = '' OR c.corridor <> ctx.corridor) t WHERE route_rank <= 3"""


@register("nearest_corridors", processed_ctes("requests", extra={"knn5": KNN5_SQL, "ctx": CONTEXT_SQL}) +
          NEAREST_CORRIDORS_SQL)
def q_nearest_corridors(spark, sf_dir):
    """Three nearest corridors other than the request's own (context) one."""
    hist = stored_history(spark, sf_dir)
    req = requests_df(spark, sf_dir)
    ctx = spatial.nearest_context(req, hist).select("request_id", F.col("corridor").alias("ctx_corridor"))
    out = spatial.nearest_corridors(req.join(ctx, "request_id"), hist, exclude_col="ctx_corridor")
    return out.select("request_id", F.col("route_rank").cast("int").alias("route_rank"), "corridor",
                      "latitude", "longitude", F.round("distance_km", 6).alias("distance_km"))


DEPLOY_SQL = """WITH base AS (SELECT id AS request_id, lat, lon, greatest(barricades, 0) AS nb, greatest(personnel, 0) AS np
  FROM register),
bar AS (SELECT request_id, 'barricade' AS kind, i AS idx, 360e0 / nb * i AS bearing, lat, lon FROM base,
  generate_series(0, nb - 1) g(i) WHERE nb > 0),
offb AS (SELECT request_id, 'officer' AS kind, i AS idx, 360e0 / nb * i AS bearing, lat, lon FROM base,
  generate_series(0, least(np, nb) - 1) g(i) WHERE least(np, nb) > 0),
rest AS (SELECT request_id, 'officer' AS kind, least(np, nb) + i AS idx,
  CASE WHEN np - least(np, nb) > 1 THEN 360e0 / (np - least(np, nb)) * i ELSE 0e0 END AS bearing, lat, lon, 1 AS ring
  FROM base, generate_series(0, np - least(np, nb) - 1) g(i) WHERE np - least(np, nb) > 0),
pts AS (SELECT request_id, kind, idx, bearing, lat, lon, 130e0 AS m FROM bar
  UNION ALL SELECT request_id, kind, idx, bearing, lat, lon, 130e0 FROM offb
  UNION ALL SELECT request_id, kind, idx, bearing, lat, lon, 28e0 FROM rest)
SELECT request_id, kind, CAST(idx AS INT) AS idx, round(bearing, 6) AS bearing,
  round(lat + m * cos(radians(bearing)) / 111320e0, 9) AS lat,
  round(lon + m * sin(radians(bearing)) / (111320e0 * cos(radians(lat))), 9) AS lon FROM pts"""


@register("deployment_points", with_ctes(["register"]) + DEPLOY_SQL.replace("WITH base", ", base", 1)
          .replace(", base", "base", 0))
def q_deployment(spark, sf_dir):
    """C10 + C12: ring placement of the register's barricades and officers."""
    reg = register_df(spark, sf_dir).select(F.col("id").alias("request_id"), "lat", "lon",
                                            F.col("barricades").alias("barricade_points"), "personnel")
    pts = spatial.deployment_points(reg)
    return pts.select("request_id", "kind", F.col("idx").cast("int").alias("idx"), F.round("bearing", 6).alias("bearing"),
                      F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@register("offset_bearing_roundtrip", processed_ctes() + """SELECT id, b AS bearing_in,
  round((degrees(atan2(sin(radians(lon2 - longitude)) * cos(radians(lat2)),
    cos(radians(latitude)) * sin(radians(lat2)) - sin(radians(latitude)) * cos(radians(lat2)) * cos(radians(lon2 - longitude))))
    + 360e0) % 360e0, 3) AS bearing_back
FROM (SELECT id, latitude, longitude, b,
  latitude + 200e0 * cos(radians(b)) / 111320e0 AS lat2,
  longitude + 200e0 * sin(radians(b)) / (111320e0 * cos(radians(latitude))) AS lon2
  FROM (SELECT id, latitude, longitude, CAST(CAST(substr(id, 4) AS BIGINT) % 8 * 45 AS DOUBLE) AS b FROM processed) s) t""")
def q_offset_bearing(spark, sf_dir):
    """C10 + C11: move every incident 200 m along one of 8 bearings and
    measure the bearing back (round trip, 3 decimals)."""
    p = processed(spark, sf_dir).select("id", "latitude", "longitude",
                                        (F.substring("id", 4, 20).cast("long") % 8 * 45).cast("double").alias("b"))
    lat2, lon2 = G.offset_point("latitude", "longitude", F.lit(200.0), "b")
    p = p.select("id", "latitude", "longitude", "b", lat2.alias("lat2"), lon2.alias("lon2"))
    back = G.bearing_between("latitude", "longitude", "lat2", "lon2")
    return p.select("id", F.col("b").alias("bearing_in"), F.round(back, 3).alias("bearing_back"))


@register("detect_conflicts", with_ctes(["register"]) + f"""SELECT a.id AS id_a, b.id AS id_b,
  round({hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000, 6) AS distance_m,
  a.personnel + b.personnel AS combined_personnel
FROM register a JOIN register b ON a.id < b.id
WHERE a.status = 'active' AND b.status = 'active' AND {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000 < 500e0""")
def q_conflicts(spark, sf_dir):
    c = spatial.detect_conflicts(register_df(spark, sf_dir))
    return c.withColumn("distance_m", F.round("distance_m", 6))


# ---------------------------------------------------------------- F: scoring
from roadpulse.functions import scoring as S  # noqa: E402
from roadpulse.operators import scoring  # noqa: E402
from roadpulse.plans.oracle import BASE_PERSONNEL_VALUES  # noqa: E402


def scenarios(spark, sf_dir) -> DataFrame:
    return FX.fixture(spark, sf_dir, "scenario_scores")


_VALID = "valid AS (SELECT duration_min AS d FROM processed WHERE duration_valid)"
_PCT_SQL = """CASE WHEN s.ml_duration_min IS NULL OR isnan(s.ml_duration_min) OR (SELECT count(*) FROM valid) = 0 THEN 5e-1
  ELSE (SELECT count(*) FROM valid WHERE d < s.ml_duration_min) / (SELECT count(*) FROM valid) END"""


@register("duration_histogram", processed_ctes() + """SELECT CAST(floor(duration_min) AS INT) AS bucket, count(*) AS n,
  coalesce(sum(count(*)) OVER (ORDER BY CAST(floor(duration_min) AS INT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS below
FROM processed WHERE duration_valid GROUP BY 1""")
def q_duration_histogram(spark, sf_dir):
    """the valid-duration reference distribution as a minute histogram."""
    return scoring.duration_histogram(processed(spark, sf_dir))


@register("duration_percentile", processed_ctes("scenario_scores", extra={"valid": _VALID.split(" AS ", 1)[1][1:-1]}) +
          f"SELECT s.request_id, {_PCT_SQL} AS duration_pct FROM scenario_scores s")
def q_duration_percentile(spark, sf_dir):
    """percentile of each request's duration estimate in the history."""
    out = scoring.duration_percentile(scenarios(spark, sf_dir), processed(spark, sf_dir), "ml_duration_min")
    return out.select("request_id", "duration_pct")


_IMPACT_SQL = f"""SELECT request_id, closure_p, duration_pct, priority_used, is_corridor,
  closure_p * 40e0 AS c_closure, duration_pct * 35e0 AS c_duration,
  (CASE WHEN lower(priority_used) = 'high' THEN 1e0 ELSE 3e-1 END) * 15e0 AS c_priority,
  (CASE WHEN is_corridor = 1 THEN 1e0 ELSE 25e-2 END) * 10e0 AS c_corridor
FROM (SELECT s.*, coalesce(nullif(s.priority_override, ''), s.suggested_priority) AS priority_used,
  {_PCT_SQL} AS duration_pct FROM scenario_scores s) x"""

_IMPACT_OUT = """request_id, round(c_closure + c_duration + c_priority + c_corridor, 1) AS impact_score,
  CASE WHEN raw >= 0 AND raw < 25 THEN 'Low' WHEN raw >= 25 AND raw < 50 THEN 'Medium'
       WHEN raw >= 50 AND raw < 75 THEN 'High' ELSE 'Critical' END AS impact_band,
  CASE WHEN raw >= 0 AND raw < 25 THEN '#34D399' WHEN raw >= 25 AND raw < 50 THEN '#F5A623'
       WHEN raw >= 50 AND raw < 75 THEN '#F2784B' ELSE '#E5484D' END AS impact_color,
  round(duration_pct * 100, 1) AS duration_percentile, round(c_closure, 1) AS component_closure,
  round(c_duration, 1) AS component_duration, round(c_priority, 1) AS component_priority,
  round(c_corridor, 1) AS component_corridor"""


def _scored(spark, sf_dir):
    s = scenarios(spark, sf_dir).withColumn("priority_used", S.resolve_priority("priority_override", "suggested_priority"))
    s = scoring.duration_percentile(s, processed(spark, sf_dir), "ml_duration_min")
    return s.withColumns(S.impact_columns("closure_p", "duration_pct", "priority_used", "is_corridor"))


@register("impact_index", processed_ctes("scenario_scores", extra={"valid": "SELECT duration_min AS d FROM processed WHERE duration_valid",
                                                                    "imp": _IMPACT_SQL}) +
          f"SELECT {_IMPACT_OUT} FROM (SELECT *, c_closure + c_duration + c_priority + c_corridor AS raw FROM imp) t")
def q_impact(spark, sf_dir):
    """F3 + F4 (+F2, F8): impact score, band, colour, components."""
    return _scored(spark, sf_dir).select("request_id", "impact_score", "impact_band", "impact_color",
                                         "duration_percentile", "component_closure", "component_duration",
                                         "component_priority", "component_corridor")


@register("resource_plan", processed_ctes("scenario_scores", extra={
    "valid": "SELECT duration_min AS d FROM processed WHERE duration_valid", "imp": _IMPACT_SQL,
    "bp": f"SELECT * FROM (VALUES {BASE_PERSONNEL_VALUES}) v(event_cause, base_personnel)"}) +
          """SELECT request_id, impact_score, base_personnel,
  round(6e-1 + (impact_score / 100e0) * 14e-1, 2) AS severity_multiplier,
  CASE WHEN closure_p >= 5e-1 THEN 2 ELSE 0 END AS extra_for_closure_management,
  greatest(1, CAST(ceil(base_personnel * (6e-1 + (impact_score / 100e0) * 14e-1)
    + CASE WHEN closure_p >= 5e-1 THEN 2 ELSE 0 END) AS INT)) AS personnel,
  CASE WHEN closure_p < 3e-1 THEN 0 WHEN closure_p < 6e-1 THEN 2 WHEN is_corridor = 1 THEN 4 ELSE 3 END AS barricade_points
FROM (SELECT i.request_id, i.closure_p, i.is_corridor, coalesce(bp.base_personnel, 2) AS base_personnel,
  round(i.c_closure + i.c_duration + i.c_priority + i.c_corridor, 1) AS impact_score
  FROM imp i JOIN scenario_scores s ON s.request_id = i.request_id LEFT JOIN bp ON bp.event_cause = s.event_cause) t""")
def q_resource_plan(spark, sf_dir):
    """F5 + F6 + F7: personnel and barricades from the rounded score."""
    s = scoring.recommend_manpower(_scored(spark, sf_dir))
    s = scoring.recommend_barricades(s)
    return s.select("request_id", "impact_score", F.col("base_personnel").cast("int").alias("base_personnel"),
                    "severity_multiplier", F.col("extra_for_closure_management").cast("int")
                    .alias("extra_for_closure_management"), "personnel",
                    F.col("barricade_points").cast("int").alias("barricade_points"))


@register("resolve_priority", with_ctes(["scenario_scores"]) +
          """SELECT request_id, suggested_priority, coalesce(nullif(priority_override, ''), suggested_priority) AS priority_used,
  CASE WHEN is_corridor = 1 THEN 'High' ELSE 'Low' END AS rule_priority FROM scenario_scores""")
def q_resolve_priority(spark, sf_dir):
    """F8 + F14 rule: override wins; the corridor rule for comparison."""
    s = scenarios(spark, sf_dir)
    return s.select("request_id", "suggested_priority",
                    S.resolve_priority("priority_override", "suggested_priority").alias("priority_used"),
                    S.triage_rule("is_corridor").alias("rule_priority"))


@register("triage_gap", processed_ctes("scenario_scores", extra={
    "valid": "SELECT duration_min AS d FROM processed WHERE duration_valid", "imp": _IMPACT_SQL}) +
          """SELECT request_id, rule_priority, impact_band,
  (rule_priority = 'Low' AND impact_band IN ('High', 'Critical')) OR (rule_priority = 'High' AND impact_band = 'Low') AS gap
FROM (SELECT request_id, CASE WHEN is_corridor = 1 THEN 'High' ELSE 'Low' END AS rule_priority,
  CASE WHEN raw >= 0 AND raw < 25 THEN 'Low' WHEN raw >= 25 AND raw < 50 THEN 'Medium'
       WHEN raw >= 50 AND raw < 75 THEN 'High' ELSE 'Critical' END AS impact_band
  FROM (SELECT *, c_closure + c_duration + c_priority + c_corridor AS raw FROM imp) t) u""")
def q_triage_gap(spark, sf_dir):
    """where the corridor rule and the impact band disagree."""
    s = _scored(spark, sf_dir).withColumn("rule_priority", S.triage_rule("is_corridor"))
    return s.select("request_id", "rule_priority", "impact_band",
                    S.triage_gap("rule_priority", "impact_band").alias("gap"))


@register("precedent_stats", processed_ctes("requests", extra={"sim8": SIMILAR_SQL}) + """SELECT r.request_id,
  coalesce(p.n_precedents, 0) AS n_precedents, p.precedent_median_min, p.p10_min, p.p50_min, p.p90_min, p.n_durations
FROM requests r LEFT JOIN (
  SELECT request_id, CAST(count(*) AS INT) AS n_precedents,
    quantile_cont(CASE WHEN duration_valid THEN duration_min END, 0.5) AS precedent_median_min,
    CASE WHEN count(*) >= 3 AND count(duration_min) >= 3 THEN greatest(quantile_cont(duration_min, 0.1), 0) END AS p10_min,
    CASE WHEN count(*) >= 3 AND count(duration_min) >= 3 THEN greatest(quantile_cont(duration_min, 0.5), 0) END AS p50_min,
    CASE WHEN count(*) >= 3 AND count(duration_min) >= 3 THEN greatest(quantile_cont(duration_min, 0.9), 0) END AS p90_min,
    CASE WHEN count(*) >= 3 AND count(duration_min) >= 3 THEN CAST(count(duration_min) AS INT) END AS n_durations
  FROM sim8 WHERE distance_km <= 5e0 GROUP BY request_id) p ON p.request_id = r.request_id""")
def q_precedent_stats(spark, sf_dir):
    """F9 + F10: precedent median and P10/P50/P90 interval per request."""
    req = requests_df(spark, sf_dir)
    sim = spatial.similar_incidents(req, stored_history(spark, sf_dir))
    return scoring.precedent_stats(req, sim)


@register("closure_anomaly", processed_ctes("scenario_scores") + """SELECT request_id,
  CASE WHEN n >= 3 THEN n END AS anomaly_n, CASE WHEN n >= 3 THEN rate END AS hist_rate,
  CASE WHEN n >= 3 THEN p - rate END AS excess,
  CASE WHEN n >= 3 THEN (SELECT avg(CASE WHEN CAST(h.requires_road_closure AS DOUBLE) <= t.p THEN 1e0 ELSE 0e0 END) * 100
                         FROM processed h WHERE h.event_cause = t.event_cause AND (NOT t.use_cc OR h.corridor = t.corridor)) END
    AS percentile,
  CASE WHEN n >= 3 THEN p - rate > 15e-2 END AS is_elevated, CASE WHEN n >= 3 THEN p - rate < -15e-2 END AS is_suppressed
FROM (SELECT s.request_id, s.event_cause, s.corridor, s.closure_p AS p, u.use_cc,
    CASE WHEN u.use_cc THEN u.n_cc ELSE u.n_c END AS n, CASE WHEN u.use_cc THEN u.r_cc ELSE u.r_c END AS rate
  FROM scenario_scores s JOIN (
    SELECT s2.request_id,
      s2.corridor IS NOT NULL AND s2.corridor <> '' AND s2.corridor <> 'Non-corridor'
        AND (SELECT count(*) FROM processed h WHERE h.event_cause = s2.event_cause AND h.corridor = s2.corridor) >= 5 AS use_cc,
      (SELECT count(*) FROM processed h WHERE h.event_cause = s2.event_cause AND h.corridor = s2.corridor) AS n_cc,
      (SELECT avg(CAST(requires_road_closure AS DOUBLE)) FROM processed h WHERE h.event_cause = s2.event_cause AND h.corridor = s2.corridor) AS r_cc,
      (SELECT count(*) FROM processed h WHERE h.event_cause = s2.event_cause) AS n_c,
      (SELECT avg(CAST(requires_road_closure AS DOUBLE)) FROM processed h WHERE h.event_cause = s2.event_cause) AS r_c
    FROM scenario_scores s2) u ON u.request_id = s.request_id) t""")
def q_closure_anomaly(spark, sf_dir):
    """closure probability against the historical base rate."""
    return scoring.closure_anomaly(scenarios(spark, sf_dir), processed(spark, sf_dir))


_AVAILABLE_SQL = "SELECT DISTINCT shift_id, CAST(10 + shift_id * 7 AS BIGINT) AS available FROM register"


@register("optimize_allocation", with_ctes(["register"], {"avail": _AVAILABLE_SQL}) + """SELECT shift_id, id, impact_score,
  personnel, allocated, CAST(greatest(personnel - allocated, 0) AS BIGINT) AS shortfall FROM (
  SELECT *, CAST(CASE WHEN pos = n THEN greatest(available - before, 0)
                      ELSE least(greatest(available - before, 0), want) END AS BIGINT) AS allocated FROM (
    SELECT *, coalesce(sum(want) OVER (PARTITION BY shift_id ORDER BY impact_score DESC, id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (PARTITION BY shift_id ORDER BY impact_score DESC, id) AS pos FROM (
      SELECT r.*, a.available, count(*) OVER (PARTITION BY r.shift_id) AS n,
        greatest(1, CAST(round_even(a.available * r.impact_score /
          CASE WHEN sum(r.impact_score) OVER (PARTITION BY r.shift_id) = 0 THEN 1e0
               ELSE sum(r.impact_score) OVER (PARTITION BY r.shift_id) END, 0) AS BIGINT)) AS want
      FROM register r JOIN avail a ON a.shift_id = r.shift_id WHERE r.status = 'active' AND a.available > 0) x) y) z""")
def q_allocation(spark, sf_dir):
    """impact-weighted officer allocation per shift."""
    reg = register_df(spark, sf_dir)
    avail = reg.select("shift_id").distinct().select("shift_id", (F.lit(10) + F.col("shift_id") * 7)
                                                     .cast("long").alias("available"))
    return scoring.optimize_allocation(reg, avail)


@register("register_kpis", with_ctes(["register"]) + """SELECT count(CASE WHEN status = 'active' THEN 1 END) AS active_events,
  count(CASE WHEN status <> 'active' THEN 1 END) AS resolved_events,
  CAST(coalesce(sum(CASE WHEN status = 'active' THEN personnel END), 0) AS BIGINT) AS total_personnel,
  CAST(coalesce(sum(CASE WHEN status = 'active' THEN barricades END), 0) AS BIGINT) AS total_barricades,
  count(CASE WHEN status = 'active' AND band = 'Critical' THEN 1 END) AS critical_active FROM register""")
def q_register_kpis(spark, sf_dir):
    """Totals over the active-events register."""
    return dashboards.register_kpis(register_df(spark, sf_dir))


# ------------------------------------------------ A3-A5, F18, F19: feedback
import uuid  # noqa: E402

from roadpulse.operators import register as reg_ops  # noqa: E402
from roadpulse.sources import feedback as fb  # noqa: E402

_KEY_SQL = "concat_ws('|', " + ", ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in fb.SUBMITTED) + ")"
OUTCOME_ROWS_SQL = f"""SELECT 'fb-' || md5({_KEY_SQL}) AS id, event_type, lat AS latitude, lon AS longitude,
  address, event_cause, requires_road_closure, start_datetime, actual_end_datetime AS end_datetime, 'resolved' AS status,
  priority, corridor, start_datetime AS created_date, police_station, actual_end_datetime AS closed_datetime,
  actual_end_datetime AS resolved_datetime, CAST(NULL AS VARCHAR) AS zone, CAST(NULL AS VARCHAR) AS junction,
  CAST(manpower_used AS INT) AS logged_manpower_used, forecast_impact_score, escalated_beyond_forecast,
  notes AS feedback_notes FROM outcomes"""


def outcomes_df(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "outcomes")


@register("log_outcomes", with_ctes(["outcomes"]) + OUTCOME_ROWS_SQL)
def q_log_outcomes(spark, sf_dir):
    """A4 projection (the log-time stamp excluded from the comparison)."""
    return fb.outcome_rows(outcomes_df(spark, sf_dir)).drop("feedback_logged_at")


@register("feedback_log_roundtrip", with_ctes(["outcomes"]) + f"SELECT DISTINCT * FROM ({OUTCOME_ROWS_SQL}) o")
def q_feedback_roundtrip(spark, sf_dir):
    """A3 + A4: log the outcomes twice into a fresh log and read it back;
    the replay adds nothing (ids are content-derived)."""
    path = scratch_path(spark, f"feedback_log_{uuid.uuid4().hex[:12]}")
    assert fb.load_feedback(spark, path).isEmpty()
    outs = outcomes_df(spark, sf_dir)
    fb.log_outcomes(outs, path)
    fb.log_outcomes(outs, path)
    return fb.load_feedback(spark, path).drop("feedback_logged_at")


@register("augment_with_feedback", with_ctes(["incidents_raw", "outcomes"], {
    "fbrows": OUTCOME_ROWS_SQL,
    "aug": """SELECT * EXCLUDE (comment, map_file) FROM incidents_raw UNION ALL
      SELECT id, event_type, CAST(latitude AS VARCHAR), CAST(longitude AS VARCHAR), address, event_cause,
        CAST(requires_road_closure AS VARCHAR), start_datetime, end_datetime, status, priority, corridor, created_date,
        police_station, closed_datetime, resolved_datetime, zone, junction FROM fbrows""",
    "incidents": RAW_PARSED_SQL.replace("FROM incidents_raw", "FROM aug"),
    "processed": PROCESSED_SQL}) +
          f"SELECT id, event_cause, start_ts, {_r('duration_min')} AS duration_min, duration_valid FROM processed")
def q_augment(spark, sf_dir):
    """A5: export + feedback log in one processed table (mixed timestamp
    formats parsed per value)."""
    raw = raw_incidents(spark, sf_dir)
    aug = fb.augment_with_feedback(raw, fb.outcome_rows(outcomes_df(spark, sf_dir)))
    p = cleaning.prepare_incidents(aug)
    return p.select("id", "event_cause", "start_ts", F.round("duration_min", 6).alias("duration_min"), "duration_valid")


@register("forecast_vs_outcome", with_ctes(["outcomes"], {
    "fbrows": OUTCOME_ROWS_SQL,
    "bp": f"SELECT * FROM (VALUES {BASE_PERSONNEL_VALUES}) v(event_cause, base_personnel)"}) +
          """SELECT g.*, coalesce(bp.base_personnel, 2) AS base_personnel,
  g.avg_manpower_used - coalesce(bp.base_personnel, 2) AS manpower_gap
FROM (SELECT event_cause, count(*) AS n, avg(logged_manpower_used) AS avg_manpower_used,
  avg(CAST(escalated_beyond_forecast AS DOUBLE)) AS escalation_rate, avg(forecast_impact_score) AS mean_forecast_score
  FROM fbrows GROUP BY event_cause) g LEFT JOIN bp ON bp.event_cause = g.event_cause""")
def q_forecast_vs_outcome(spark, sf_dir):
    """outcomes vs the resource constants, per cause."""
    return reg_ops.forecast_vs_outcome(fb.outcome_rows(outcomes_df(spark, sf_dir)))


@register("register_add", processed_ctes("scenario_scores", "register", extra={
    "valid": "SELECT duration_min AS d FROM processed WHERE duration_valid", "imp": _IMPACT_SQL}) + """SELECT id, cause,
  status, impact_score, band FROM register UNION ALL
SELECT md5(s.request_id || '|' || strftime(s.requested_at, '%Y-%m-%d %H:%M:%S.%f')), s.event_cause, 'active',
  round(i.c_closure + i.c_duration + i.c_priority + i.c_corridor, 1),
  CASE WHEN raw >= 0 AND raw < 25 THEN 'Low' WHEN raw >= 25 AND raw < 50 THEN 'Medium'
       WHEN raw >= 50 AND raw < 75 THEN 'High' ELSE 'Critical' END
FROM (SELECT *, c_closure + c_duration + c_priority + c_corridor AS raw FROM imp) i
JOIN scenario_scores s ON s.request_id = i.request_id""")
def q_register_add(spark, sf_dir):
    """forecasts appended to the active-events register."""
    s = scoring.recommend_barricades(scoring.recommend_manpower(_scored(spark, sf_dir)))
    s = s.withColumn("police_station", F.lit("Unknown"))
    out = reg_ops.add_to_register(register_df(spark, sf_dir), s)
    return out.select("id", "cause", "status", "impact_score", "band")


@register("register_resolve_all", with_ctes(["register"]) +
          "SELECT id, 'resolved' AS status FROM register")
def q_register_resolve(spark, sf_dir):
    """resolve every event of the register."""
    return reg_ops.resolve_all(register_df(spark, sf_dir)).select("id", "status")


# ---------------------------------------------------------------- weather
from roadpulse.operators import weather as W  # noqa: E402

WEATHER_SQL = """SELECT reading_ts, source,
  CASE WHEN available THEN rain_mm END AS rain_mm, CASE WHEN available THEN weathercode END AS weathercode,
  CASE WHEN available THEN temperature END AS temperature, CASE WHEN available THEN wind END AS wind,
  CASE WHEN available THEN wind_unit END AS wind_unit,
  CASE WHEN available THEN description ELSE 'unavailable' END AS description,
  is_rain, is_heavy, 1e0 + CASE WHEN is_rain THEN 25e-2 ELSE 0e0 END + CASE WHEN is_heavy THEN 25e-2 ELSE 0e0 END AS multiplier,
  available FROM (
  SELECT *,
    CASE WHEN NOT available THEN false WHEN source = 'open_meteo' THEN rain_mm > 0 OR weathercode BETWEEN 51 AND 99
         ELSE rain_mm > 0 OR regexp_matches(lower(description), 'rain|drizzle|shower|thunderstorm') END AS is_rain,
    CASE WHEN NOT available THEN false WHEN source = 'open_meteo' THEN rain_mm > 5 OR weathercode >= 80
         ELSE rain_mm > 5 OR regexp_matches(lower(description), 'heavy|torrential|thunderstorm') END AS is_heavy
  FROM (SELECT reading_ts, source, available, rain_mm, weathercode, temperature, wind, wind_unit,
    CASE WHEN source = 'open_meteo' THEN
      CASE WHEN weathercode BETWEEN 0 AND 3 THEN 'Clear / mostly clear' WHEN weathercode BETWEEN 10 AND 19 THEN 'Mist / haze'
           WHEN weathercode BETWEEN 20 AND 29 THEN 'Recent precipitation' WHEN weathercode BETWEEN 40 AND 49 THEN 'Fog'
           WHEN weathercode BETWEEN 51 AND 67 THEN 'Drizzle or rain' WHEN weathercode BETWEEN 71 AND 77 THEN 'Snow'
           WHEN weathercode BETWEEN 80 AND 82 THEN 'Rain showers' WHEN weathercode BETWEEN 95 AND 99 THEN 'Thunderstorm'
           ELSE 'Overcast/cloudy' END
    ELSE coalesce(json_extract_string(jb, '$.current_condition[0].weatherDesc[0].value'), 'Cloudy') END AS description
  FROM (SELECT reading_ts, source, jb,
    CASE WHEN source = 'open_meteo' THEN json_extract(jb, '$.current') IS NOT NULL
         ELSE json_extract(jb, '$.current_condition[0]') IS NOT NULL END AS available,
    CASE WHEN v_rain IS NULL OR v_rain = 0 THEN 0e0 ELSE v_rain END AS rain_mm,
    CAST(CASE WHEN v_code IS NULL OR v_code = 0 THEN 0e0 ELSE v_code END AS INTEGER) AS weathercode,
    CASE WHEN v_temp IS NULL OR v_temp = 0 THEN 28e0 ELSE v_temp END AS temperature,
    CASE WHEN v_wind IS NULL OR v_wind = 0 THEN 0e0 ELSE v_wind END / CASE WHEN source = 'open_meteo' THEN 1e0 ELSE 36e-1 END AS wind,
    CASE WHEN source = 'open_meteo' THEN 'km/h' ELSE 'm/s' END AS wind_unit
  FROM (SELECT received_at AS reading_ts, source, jb,
    TRY_CAST(CASE WHEN source = 'open_meteo' THEN json_extract_string(jb, '$.current.precipitation')
                  ELSE json_extract_string(jb, '$.current_condition[0].precipMM') END AS DOUBLE) AS v_rain,
    TRY_CAST(CASE WHEN source = 'open_meteo' THEN json_extract_string(jb, '$.current.weathercode')
                  ELSE json_extract_string(jb, '$.current_condition[0].weatherCode') END AS DOUBLE) AS v_code,
    TRY_CAST(CASE WHEN source = 'open_meteo' THEN json_extract_string(jb, '$.current.temperature_2m')
                  ELSE json_extract_string(jb, '$.current_condition[0].temp_C') END AS DOUBLE) AS v_temp,
    TRY_CAST(CASE WHEN source = 'open_meteo' THEN json_extract_string(jb, '$.current.windspeed_10m')
                  ELSE json_extract_string(jb, '$.current_condition[0].windspeedKmph') END AS DOUBLE) AS v_wind
  FROM (SELECT received_at, source, CASE WHEN json_valid(body) THEN body END AS jb FROM weather_payloads) a) b) c) d) e"""


def weather_df(spark, sf_dir):
    return W.parse_weather_payloads(FX.fixture(spark, sf_dir, "weather_payloads"))


@register("weather_readings", with_ctes(["weather_payloads"]) + WEATHER_SQL)
def q_weather_readings(spark, sf_dir):
    """A8 + B14 + B15: typed readings with description, rain flags and
    multiplier from both provider shapes."""
    return weather_df(spark, sf_dir)


ASOF_SQL = """SELECT s.request_id, w.reading_ts, w.source, coalesce(w.multiplier, 1e0) AS multiplier,
  coalesce(w.is_rain, false) AS is_rain FROM scenario_scores s LEFT JOIN (
  SELECT s2.request_id, w2.* FROM scenario_scores s2 JOIN weather w2
    ON w2.reading_ts <= s2.requested_at AND w2.reading_ts >= s2.requested_at - INTERVAL 30 MINUTE
  QUALIFY row_number() OVER (PARTITION BY s2.request_id ORDER BY w2.reading_ts DESC, w2.source) = 1) w
  ON w.request_id = s.request_id"""


@register("weather_asof_join", with_ctes(["weather_payloads", "scenario_scores"], {"weather": WEATHER_SQL}) + ASOF_SQL)
def q_weather_asof(spark, sf_dir):
    """latest reading at most 30 minutes old at request time."""
    j = W.weather_asof_join(scenarios(spark, sf_dir), weather_df(spark, sf_dir))
    return j.select("request_id", "reading_ts", "source", "multiplier", "is_rain")


@register("weather_adjust", with_ctes(["weather_payloads", "scenario_scores"], {"weather": WEATHER_SQL, "wx_asof": ASOF_SQL}) +
          f"""SELECT s.request_id, round(s.closure_p, 3) AS closure_probability,
  a.is_rain AND s.event_cause IN ({', '.join(repr(c) for c in W.RAIN_SENSITIVE)}) AS weather_adjusted,
  CASE WHEN a.is_rain AND s.event_cause IN ({', '.join(repr(c) for c in W.RAIN_SENSITIVE)})
       THEN least(1e0, round(s.closure_p, 3) * a.multiplier) ELSE round(s.closure_p, 3) END AS adjusted_closure
FROM scenario_scores s JOIN wx_asof a ON a.request_id = s.request_id""")
def q_weather_adjust(spark, sf_dir):
    """rain adjustment of the closure probability."""
    s = scenarios(spark, sf_dir)
    j = s.join(W.weather_asof_join(s, weather_df(spark, sf_dir)).select("request_id", "is_rain", "multiplier"),
               "request_id")
    return W.weather_adjust(j).select("request_id", "closure_probability", "weather_adjusted", "adjusted_closure")


# ---------------------------------------------------------------- E: models
import json as _json  # noqa: E402

from roadpulse.operators import metrics as MT  # noqa: E402
from roadpulse.operators import ml  # noqa: E402
from roadpulse.plans import forecast as FC  # noqa: E402

_MODEL_CACHE: dict = {}


def geo_model(spark, sf_dir):
    """C2 by itself, for queries that use no forest: fitted once per session,
    saved under the shared scratch folder and loaded back from there."""
    key = (sf_dir, "geo_kmeans", id(spark.sparkContext._jsc))
    if key not in _MODEL_CACHE:
        path = scratch_path(spark, f"geo_kmeans_{uuid.uuid4().hex[:10]}")
        ml.fit_geo_clusters(processed(spark, sf_dir)).write().save(path)
        _MODEL_CACHE[key] = path
    return ml.KMeansModel.load(_MODEL_CACHE[key])


def _fitted(spark, sf_dir, params=None):
    """Models for ``sf_dir``: fitted once per session, saved with A6 under
    the shared scratch folder and loaded back from there."""
    params = params or ml.DEFAULT_PARAMS  # the reference's 300 and 400 trees
    key = (sf_dir, _json.dumps(params, sort_keys=True), id(spark.sparkContext._jsc))
    if key not in _MODEL_CACHE:
        models, data = ml.fit_all(processed(spark, sf_dir), params=params, km=geo_model(spark, sf_dir))
        tag = hashlib.md5(repr(key[:2]).encode()).hexdigest()[:10]
        base = scratch_path(spark, f"models_{tag}_{uuid.uuid4().hex[:6]}")
        ml.save_models(models, f"{base}/models")
        _MODEL_CACHE[key] = {"base": base, "data": data}
    return key, _MODEL_CACHE[key]


def trained(spark, sf_dir, params=None, with_metrics: bool = True):
    """(models, metrics, importances); metrics (A7-logged) are computed on
    first request only, so pure scoring never pays for the evaluation."""
    key, entry = _fitted(spark, sf_dir, params)
    models = ml.load_models(f"{entry['base']}/models")
    if with_metrics and "metrics" not in entry:
        metrics, fi = ml.evaluate_all(models, entry["data"])
        ml.write_metrics(metrics, f"{entry['base']}/metrics")
        fi_saved = fi.persist()
        fi_saved.count()
        entry["metrics"] = ml.read_metrics(spark, f"{entry['base']}/metrics")
        entry["fi"] = fi_saved
    return models, entry.get("metrics"), entry.get("fi")


SCORES_TIERS = """SELECT *, """ + _TIER_SQL.format(m="actual_min") + " AS label_tier, " + \
    _TIER_SQL.format(m="pred_min") + " AS pred_tier FROM scores"


def scores_df(spark, sf_dir):
    s = FX.fixture(spark, sf_dir, "scores")
    return s.withColumns({"label_tier": T.duration_tier("actual_min"), "pred_tier": T.duration_tier("pred_min")})


SPLIT_SQL = """SELECT *, CASE WHEN row_number() OVER (ORDER BY start_ts, id) <= floor(count(*) OVER () * 8e-1)
  THEN 'train' ELSE 'test' END AS split FROM processed"""


@register("time_split", processed_ctes(extra={"split_t": SPLIT_SQL}) + "SELECT id, split FROM split_t")
def q_time_split(spark, sf_dir):
    """Earliest 80% by start time -> train, rest -> test."""
    return ml.time_split(processed(spark, sf_dir)).select("id", "split")


@register("class_weights", processed_ctes(extra={"split_t": SPLIT_SQL}) + """SELECT requires_road_closure,
  count(*) AS n, (SELECT count(*) FROM split_t WHERE split = 'train') /
    ((SELECT count(DISTINCT requires_road_closure) FROM split_t WHERE split = 'train') * count(*)) AS weight
FROM split_t WHERE split = 'train' GROUP BY requires_road_closure""")
def q_class_weights(spark, sf_dir):
    """Balanced class weights of the closure label on the train split."""
    tr = ml.time_split(processed(spark, sf_dir)).where(F.col("split") == "train")
    w = ml.with_class_weights(tr, "requires_road_closure")
    return w.groupBy("requires_road_closure").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))


@register("rank_metrics", with_ctes(["scores"]) + """SELECT sum(pos * (neg_below + neg / 2e0)) / (sum(pos) * sum(neg)) AS roc_auc,
  sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) END) / sum(pos) AS pr_auc FROM (
  SELECT score, pos, neg,
    coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
    sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores
    WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY score) g) c""")
def q_rank_metrics(spark, sf_dir):
    """E8 + E9: exact ROC-AUC and step average precision."""
    return MT.rank_metrics(scores_df(spark, sf_dir), "label", "score")


@register("binary_metrics", with_ctes(["scores"]) + """SELECT tp, fp, tn, fn, positive_rate, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall FROM (
    SELECT count(CASE WHEN label = 1 AND score >= 5e-1 THEN 1 END) AS tp,
      count(CASE WHEN label <> 1 AND score >= 5e-1 THEN 1 END) AS fp,
      count(CASE WHEN label <> 1 AND score < 5e-1 THEN 1 END) AS tn,
      count(CASE WHEN label = 1 AND score < 5e-1 THEN 1 END) AS fn,
      avg(CAST(label AS DOUBLE)) AS positive_rate FROM scores WHERE score IS NOT NULL AND NOT isnan(score)) a) b""")
def q_binary_metrics(spark, sf_dir):
    """Metrics at threshold 0.5."""
    return MT.binary_metrics(scores_df(spark, sf_dir), "label", "score")


@register("multiclass_metrics", with_ctes(["scores"], {"st": SCORES_TIERS}) + """SELECT
  sum(tp) / sum(sup) AS accuracy, sum(f1 * sup) / sum(sup) AS f1_weighted, avg(f1) AS f1_macro FROM (
  SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0e0 END AS f1 FROM (
    SELECT k, coalesce(sup, 0) AS sup, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp,
      CASE WHEN coalesce(np, 0) > 0 THEN coalesce(tp, 0) / np ELSE 0e0 END AS pr,
      CASE WHEN coalesce(sup, 0) > 0 THEN coalesce(tp, 0) / sup ELSE 0e0 END AS rc
    FROM (SELECT coalesce(a.k, b.k) AS k, a.sup, b.np FROM
           (SELECT label_tier AS k, count(*) AS sup FROM st GROUP BY 1) a
           FULL JOIN (SELECT pred_tier AS k, count(*) AS np FROM st GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k) s
    LEFT JOIN (SELECT label_tier AS k2, count(*) AS tp FROM st WHERE label_tier = pred_tier GROUP BY 1) c
      ON c.k2 IS NOT DISTINCT FROM s.k) x) y""")
def q_multiclass(spark, sf_dir):
    """Accuracy, weighted and macro F1 of tier predictions."""
    return MT.multiclass_metrics(scores_df(spark, sf_dir), "label_tier", "pred_tier")


@register("tier_confusion", with_ctes(["scores"], {"st": SCORES_TIERS}) + """SELECT CAST(a.i AS INT) AS row, CAST(p.i AS INT) AS col,
  a.v AS actual, p.v AS predicted, count(st.label_tier) AS n
FROM (VALUES (0, 'Quick (<30 min)'), (1, 'Moderate (30-120 min)'), (2, 'Prolonged (>120 min)')) a(i, v)
CROSS JOIN (VALUES (0, 'Quick (<30 min)'), (1, 'Moderate (30-120 min)'), (2, 'Prolonged (>120 min)')) p(i, v)
LEFT JOIN st ON st.label_tier = a.v AND st.pred_tier = p.v GROUP BY 1, 2, 3, 4""")
def q_tier_confusion(spark, sf_dir):
    """Tier confusion matrix in label order."""
    from roadpulse.constants import TIER_LABELS
    return MT.confusion_long(scores_df(spark, sf_dir), TIER_LABELS, "label_tier", "pred_tier")


@register("regression_metrics", with_ctes(["scores"], {"sv": "SELECT * FROM scores WHERE actual_min > 0 AND pred_min > 0"}) +
          """SELECT avg(abs(actual_min - pred_min)) AS mae_minutes,
  quantile_cont(abs(actual_min - pred_min), 0.5) AS median_ae_minutes,
  1 - sum(pow(ln(1 + actual_min) - ln(1 + pred_min), 2)) /
      sum(pow(ln(1 + actual_min) - (SELECT avg(ln(1 + actual_min)) FROM sv), 2)) AS r2_log_space,
  quantile_cont(actual_min, 0.5) AS median_actual_minutes, count(*) AS n FROM sv""")
def q_regression(spark, sf_dir):
    """MAE, median AE, R^2 in log space (rows in the log domain)."""
    s = scores_df(spark, sf_dir).where((F.col("actual_min") > 0) & (F.col("pred_min") > 0))
    return MT.regression_metrics(s, "actual_min", "pred_min")


@register("naive_baselines", processed_ctes(extra={"split_t": SPLIT_SQL}) + f"""SELECT
  (SELECT avg(abs(duration_min - (SELECT quantile_cont(duration_min, 0.5) FROM split_t WHERE split = 'train' AND duration_valid)))
   FROM split_t WHERE split = 'test' AND duration_valid) AS naive_baseline_mae_minutes,
  (SELECT avg(CASE WHEN {_TIER_SQL.format(m='duration_min')} = (
      SELECT t FROM (SELECT {_TIER_SQL.format(m='duration_min')} AS t, count(*) AS n FROM split_t
                     WHERE split = 'train' AND duration_valid GROUP BY 1) m
      ORDER BY n DESC, CASE t WHEN 'Quick (<30 min)' THEN 1 WHEN 'Moderate (30-120 min)' THEN 2 ELSE 3 END LIMIT 1)
    THEN 1e0 ELSE 0e0 END) FROM split_t WHERE split = 'test' AND duration_valid) AS tier_naive_baseline_accuracy""")
def q_naive(spark, sf_dir):
    """Train-median MAE and train-mode tier accuracy on the test split."""
    from roadpulse.constants import TIER_LABELS
    sp = ml.time_split(processed(spark, sf_dir)).where("duration_valid") \
        .withColumn("tier", T.duration_tier("duration_min"))
    return MT.naive_baselines(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test"),
                              "duration_min", "tier", TIER_LABELS)


@register("geo_clusters")
def q_geo_clusters(spark, sf_dir):
    """C2 + C3: KMeans(50) over the history, cluster of every request."""
    req = requests_df(spark, sf_dir).withColumns({"latitude": F.col("lat"), "longitude": F.col("lon")})
    return ml.assign_geo_cluster(geo_model(spark, sf_dir), req).select("request_id", "geo_cluster")


@register("train_models")
def q_train_models(spark, sf_dir):
    """E1 + E3-E7 + E15 (+A6/A7): four forests on the time split; the
    long metrics table of the run."""
    _, metrics, _ = trained(spark, sf_dir)
    return metrics.select("model", "metric", "value")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Top-15 importances of the closure, duration and tier models."""
    _, _, fi = trained(spark, sf_dir)
    return fi.select("model", "feature", "importance")


from roadpulse.constants import FESTIVAL_WINDOWS as _FW  # noqa: E402

_FESTIVAL_REQ = " OR ".join(f"CAST(r.when_ist AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in _FW)

_ASSEMBLE_SQL = f"""SELECT c.request_id, c.corridor, c.police_station, c.zone, coalesce(c.is_corridor, 0) AS is_corridor,
  round(c.nearest_distance_km, 6) AS nearest_distance_km,
  hour(r.when_ist) AS hour, month(r.when_ist) AS month,
  CASE WHEN isodow(r.when_ist) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(r.when_ist) <= 4 THEN 'Late Night (00-04)' WHEN hour(r.when_ist) <= 7 THEN 'Early Morning (04-07)'
       WHEN hour(r.when_ist) <= 10 THEN 'Morning (07-10)' WHEN hour(r.when_ist) <= 16 THEN 'Midday (10-16)'
       WHEN hour(r.when_ist) <= 19 THEN 'Evening (16-19)' WHEN hour(r.when_ist) <= 22 THEN 'Night Peak (19-22)'
       ELSE 'Late Night (22-24)' END AS daypart,
  CASE WHEN {_FESTIVAL_REQ} THEN 1 ELSE 0 END AS is_festival_window,
  round(sin(2*pi()*hour(r.when_ist)/24e0), 6) AS hour_sin, round(cos(2*pi()*(isodow(r.when_ist) - 1)/7e0), 6) AS dow_cos
FROM requests r JOIN ({CONTEXT_SQL}) c ON c.request_id = r.request_id"""


@register("assemble_features", processed_ctes("requests", extra={"knn5": KNN5_SQL}) + _ASSEMBLE_SQL)
def q_assemble(spark, sf_dir):
    """F16: context + calendar features of every request (the geo cluster,
    a KMeans output, is checked in ``geo_clusters``)."""
    f = FC.assemble_features(requests_df(spark, sf_dir), stored_history(spark, sf_dir), {"geo_kmeans": geo_model(spark, sf_dir)})
    return f.select("request_id", "corridor", "police_station", "zone", "is_corridor",
                    F.round("nearest_distance_km", 6).alias("nearest_distance_km"),
                    F.hour("when_ist").alias("hour"), "month", "is_weekend", "daypart", "is_festival_window",
                    F.round("hour_sin", 6).alias("hour_sin"), F.round("dow_cos", 6).alias("dow_cos"))


@register("forecast")
def q_forecast(spark, sf_dir):
    """the end-to-end forecast of every request, flattened."""
    models, _, _ = trained(spark, sf_dir, with_metrics=False)
    fc = FC.forecast(requests_df(spark, sf_dir), stored_history(spark, sf_dir), models)
    return FC.flatten_forecast(fc)


FLAGSHIP = "forecast"


# ---------------------------------------------------------------- G: streams
from roadpulse.streaming import jobs as ST  # noqa: E402


@register("stream_forecast")
def q_stream_forecast(spark, sf_dir):
    """G1: requests landed as 5 JSON drops (one landed twice) are scored by
    the streaming forecast; a replay on the same checkpoint adds nothing."""
    models, _, _ = trained(spark, sf_dir, with_metrics=False)
    hist = stored_history(spark, sf_dir)
    base = scratch_path(spark, f"stream_forecast_{uuid.uuid4().hex[:10]}")
    req = requests_df(spark, sf_dir)
    src = ST.land_drops(req, f"{base}/in", F.col("requested_at"))
    for _ in range(2):
        ST.start_stream_forecast(spark, src, f"{base}/out", f"{base}/ckpt", hist, models, max_files=3).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


_ODD_SQL = """SELECT * EXCLUDE (k) REPLACE (CASE k WHEN 0 THEN strftime(CAST(start_datetime AS TIMESTAMP) - INTERVAL 40 DAY, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 1 THEN 'not-a-date' ELSE start_datetime END AS start_datetime,
  CASE k WHEN 2 THEN notes || ' (again)' ELSE notes END AS notes)
  FROM outcomes, (VALUES (0), (1), (2)) t(k)"""


_LOGGED_SQL = """SELECT id, event_type, latitude, longitude, address, event_cause, requires_road_closure,
  TRY_CAST(start_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS start_datetime,
  TRY_CAST(end_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS end_datetime, status, priority, corridor,
  TRY_CAST(created_date AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS created_date, police_station,
  TRY_CAST(closed_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS closed_datetime,
  TRY_CAST(resolved_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS resolved_datetime, zone, junction"""


@register("stream_living_history", processed_ctes("outcomes", "requests", extra={
    "logged": f"{_LOGGED_SQL} FROM (SELECT DISTINCT * FROM ({OUTCOME_ROWS_SQL}) d) o",
    "base": "SELECT * FROM processed",
    "incidents_2": "SELECT * FROM logged",
    "added": PROCESSED_SQL.replace("FROM incidents)", "FROM incidents_2)")}) + """
SELECT r.request_id, count(*) AS n_neighbors_used, count(*) FILTER (WHERE h.id LIKE 'fb-%') AS n_logged,
  round(min(h.distance_km), 6) AS nearest_distance_km FROM requests r JOIN (
  SELECT r.request_id, h.id, h.distance_km FROM (SELECT 1) one, requests r, LATERAL (
    SELECT x.id, KM AS distance_km FROM (
      SELECT id, latitude, longitude FROM base UNION ALL SELECT id, latitude, longitude FROM added) x
    ORDER BY distance_km, id LIMIT 5) h) h ON h.request_id = r.request_id GROUP BY r.request_id""".replace(
        "KM", hav_sql("r.lat", "r.lon", "x.latitude", "x.longitude")))
def q_stream_living_history(spark, sf_dir):
    """G1 + G2: outcomes streamed into the log and the stored history, and the
    five nearest incidents of every request afterwards, logged ones among them."""
    base = scratch_path(spark, f"stream_living_{uuid.uuid4().hex[:10]}")
    history = LivingHistory.create(processed(spark, sf_dir), f"{base}/history")
    outs = outcomes_df(spark, sf_dir)
    src = ST.land_drops(outs, f"{base}/in", F.to_timestamp("start_datetime"))
    for _ in range(2):
        ST.start_stream_feedback(spark, src, f"{base}/log", f"{base}/ckpt", max_files=3, history=history).awaitTermination()
    nn = history.knn(requests_df(spark, sf_dir).select("request_id", "lat", "lon"), 5, columns=["id"])
    return nn.groupBy("request_id").agg(
        F.count("*").alias("n_neighbors_used"), F.count(F.when(F.col("id").startswith("fb-"), 1)).alias("n_logged"),
        F.round(F.min("distance_km"), 6).alias("nearest_distance_km"))


@register("stream_feedback", with_ctes(["outcomes"], {"odd": _ODD_SQL}) + f"""SELECT DISTINCT * FROM (
  {OUTCOME_ROWS_SQL} UNION ALL {OUTCOME_ROWS_SQL.replace("FROM outcomes", "FROM odd")}) o""")
def q_stream_feedback(spark, sf_dir):
    """Outcome drops streamed into the feedback log over several
    micro-batches: one drop repeated, and a last one that holds, for every
    outcome, a copy 40 days late, one with a malformed time, and another
    submission for the same place and time.  All of them are logged once; a
    replay on the same checkpoint adds nothing."""
    outs = outcomes_df(spark, sf_dir)
    k = F.col("k")
    odd = outs.crossJoin(spark.range(3).select(F.col("id").alias("k"))).withColumn("start_datetime", F.when(k == 0, F.date_format(
        F.to_timestamp("start_datetime") - F.expr("INTERVAL 40 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, "not-a-date").otherwise(F.col("start_datetime"))).withColumn(
        "notes", F.when(k == 2, F.concat("notes", F.lit(" (again)"))).otherwise(F.col("notes"))).drop("k")
    base = scratch_path(spark, f"stream_feedback_{uuid.uuid4().hex[:10]}")
    src = ST.land_drops(outs, f"{base}/in", F.to_timestamp("start_datetime"), late=odd)
    for _ in range(2):
        ST.start_stream_feedback(spark, src, f"{base}/log", f"{base}/ckpt", max_files=3).awaitTermination()
    return fb.load_feedback(spark, f"{base}/log").drop("feedback_logged_at")


# ------------------------------------------------ C13, C15-C17: roads, places
from roadpulse.operators import roads as RD  # noqa: E402
from roadpulse.sources import briefing as BR  # noqa: E402


def road_nodes(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "road_nodes")


def road_edges(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "road_edges")


def _road_requests(spark, sf_dir):
    return requests_df(spark, sf_dir).select("request_id", "lat", "lon")


def _bearing_sql(a_lat, a_lon, b_lat, b_lon):
    return (f"((degrees(atan2(sin(radians({b_lon} - {a_lon})) * cos(radians({b_lat})), "
            f"cos(radians({a_lat})) * sin(radians({b_lat})) - sin(radians({a_lat})) * cos(radians({b_lat})) * "
            f"cos(radians({b_lon} - {a_lon})))) + 360e0) % 360e0)")


def _off_sql(lat, lon, m, b):
    return (f"round({lat} + {m} * cos(radians({b})) / 111320e0, 9)",
            f"round({lon} + {m} * sin(radians({b})) / (111320e0 * cos(radians({lat}))), 9)")


_RD_BLAT, _RD_BLON = _off_sql("node_lat", "node_lon", "90e0", "bearing")
_RD_RLAT, _RD_RLON = _off_sql("node_lat", "node_lon", "24e0", "bearing")
_RD_GLAT, _RD_GLON = _off_sql("lat", "lon", "m", "bearing")
ROAD_DEPLOY_SQL = f"""WITH plan AS (SELECT id AS request_id, lat, lon, barricades AS nb, personnel AS np FROM register),
snap AS (SELECT * FROM (
  SELECT p.request_id, n.node_id, n.lat AS node_lat, n.lon AS node_lon,
    {hav_sql('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS d
  FROM plan p CROSS JOIN road_nodes n
  QUALIFY row_number() OVER (PARTITION BY p.request_id ORDER BY d, n.node_id) = 1) t WHERE d <= 4e-1),
rk AS (SELECT s.request_id, s.node_lat, s.node_lon, e.dst AS nbr_id,
    {_bearing_sql('s.node_lat', 's.node_lon', 'm.lat', 'm.lon')} AS bearing
  FROM snap s JOIN (SELECT DISTINCT src, dst FROM road_edges) e ON e.src = s.node_id
  JOIN road_nodes m ON m.node_id = e.dst),
road AS (SELECT rk.*, row_number() OVER (PARTITION BY rk.request_id ORDER BY bearing, nbr_id) - 1 AS i,
    count(*) OVER (PARTITION BY rk.request_id) AS n_approaches, p.nb, p.np
  FROM rk JOIN plan p ON p.request_id = rk.request_id),
head AS (SELECT DISTINCT request_id, node_lat, node_lon, n_approaches,
    least(greatest(nb, 0), n_approaches) AS nbar, greatest(np, 0) AS npp FROM road),
pts AS (
  SELECT request_id, 'barricade' AS kind, i AS idx, bearing, {_RD_BLAT} AS lat, {_RD_BLON} AS lon, n_approaches
  FROM road WHERE i < least(greatest(nb, 0), n_approaches)
  UNION ALL
  SELECT request_id, 'officer', i, bearing, {_RD_BLAT}, {_RD_BLON}, n_approaches
  FROM road WHERE i < least(greatest(nb, 0), n_approaches) AND i < greatest(np, 0)
  UNION ALL
  SELECT request_id, 'officer', least(npp, nbar) + j,
    CASE WHEN npp - least(npp, nbar) > 1 THEN 360e0 / (npp - least(npp, nbar)) * j ELSE 0e0 END AS bearing,
    {_RD_RLAT.replace('bearing', 'CASE WHEN npp - least(npp, nbar) > 1 THEN 360e0 / (npp - least(npp, nbar)) * j ELSE 0e0 END')},
    {_RD_RLON.replace('bearing', 'CASE WHEN npp - least(npp, nbar) > 1 THEN 360e0 / (npp - least(npp, nbar)) * j ELSE 0e0 END')},
    n_approaches
  FROM head, generate_series(0, npp - least(npp, nbar) - 1) g(j) WHERE npp - least(npp, nbar) > 0),
geo_base AS (SELECT p.request_id, p.lat, p.lon, greatest(p.nb, 0) AS nb, greatest(p.np, 0) AS np FROM plan p
  WHERE p.request_id NOT IN (SELECT request_id FROM head)),
geo AS (
  SELECT request_id, 'barricade' AS kind, i AS idx, 360e0 / nb * i AS bearing, lat, lon, 130e0 AS m
  FROM geo_base, generate_series(0, nb - 1) g(i) WHERE nb > 0
  UNION ALL SELECT request_id, 'officer', i, 360e0 / nb * i, lat, lon, 130e0
  FROM geo_base, generate_series(0, least(np, nb) - 1) g(i) WHERE least(np, nb) > 0
  UNION ALL SELECT request_id, 'officer', least(np, nb) + i,
    CASE WHEN np - least(np, nb) > 1 THEN 360e0 / (np - least(np, nb)) * i ELSE 0e0 END, lat, lon, 28e0
  FROM geo_base, generate_series(0, np - least(np, nb) - 1) g(i) WHERE np - least(np, nb) > 0)
SELECT request_id, kind, CAST(idx AS INT) AS idx, round(bearing, 6) AS bearing, lat, lon,
  CAST(n_approaches AS BIGINT) AS n_approaches, 'road_graph' AS mode FROM pts
UNION ALL
SELECT request_id, kind, CAST(idx AS INT), round(bearing, 6), {_RD_GLAT}, {_RD_GLON}, CAST(NULL AS BIGINT),
  'geometric_fallback' FROM geo"""


@register("road_deployment_points", with_ctes(["register", "road_nodes", "road_edges"]) +
          "SELECT * FROM (" + ROAD_DEPLOY_SQL.replace("WITH plan AS", "WITH plan AS", 1) + ") z")
def q_road_deployment(spark, sf_dir):
    """Register events snapped to the road lattice (400 m), barricades
    along real approach bearings; others on the geometric ring."""
    reg = register_df(spark, sf_dir).select(F.col("id").alias("request_id"), "lat", "lon",
                                            F.col("barricades").alias("barricade_points"), "personnel")
    pts = RD.road_deployment_points(reg, road_nodes(spark, sf_dir), road_edges(spark, sf_dir))
    return pts.select("request_id", "kind", F.col("idx").cast("int").alias("idx"), F.round("bearing", 6).alias("bearing"),
                      F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "n_approaches", "mode")


@register("diversion_routes")
def q_diversion_routes(spark, sf_dir):
    """Shortest directed detours round each request's closed node."""
    return RD.diversion_routes(_road_requests(spark, sf_dir), road_nodes(spark, sf_dir), road_edges(spark, sf_dir))


@register("diversion_suggestion")
def q_diversion_suggestion(spark, sf_dir):
    """Road-graph routes where a graph node with neighbours is within
    reach, else the nearest-corridor fallback."""
    req = requests_df(spark, sf_dir)
    hist = stored_history(spark, sf_dir)
    ctx = spatial.nearest_context(req, hist).select("request_id", "corridor")
    fb_ = FC.diversion_fallback(req.join(ctx, "request_id"), hist)
    road = RD.diversion_routes(req.select("request_id", "lat", "lon"), road_nodes(spark, sf_dir),
                               road_edges(spark, sf_dir))
    j = req.select("request_id").join(fb_, "request_id", "left").join(
        road.select("request_id", "approach_count", F.col("suggested_routes").alias("_rr")), "request_id", "left")
    on_road = F.col("approach_count").isNotNull()
    return j.select("request_id",
                    F.when(on_road, F.lit("road_graph")).otherwise(F.lit("historical_fallback")).alias("mode"),
                    "approach_count",
                    F.when(on_road, F.col("_rr")).otherwise(F.col("suggested_routes")).alias("suggested_routes"))


def gazetteer_df(spark, sf_dir):
    return RD.build_gazetteer(processed(spark, sf_dir))


_GAZ_SQL = r"""SELECT q.query_id, q.query, g.lat, g.lon, g.display_name FROM (
  SELECT *, CASE WHEN trim(query) = '' THEN NULL
    ELSE trim(regexp_replace(regexp_replace(lower(trim(query)), ',\s*bengaluru.*$', ''), '\s+', ' ', 'g')) END AS key
  FROM place_queries) q
LEFT JOIN (SELECT *, trim(regexp_replace(regexp_replace(lower(display_name), ',\s*bengaluru.*$', ''), '\s+', ' ', 'g')) AS key
  FROM (SELECT regexp_replace(trim(regexp_replace(regexp_replace(junction, '([A-Z])', ' \1', 'g'), '\s+', ' ', 'g')),
                 '\bJunc\b', 'Junction', 'g') AS display_name, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS n
        FROM processed WHERE junction IS NOT NULL GROUP BY junction) j) g ON g.key = q.key
QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY g.n DESC, g.display_name) = 1"""


@register("gazetteer_lookup", processed_ctes("place_queries") + _GAZ_SQL)
def q_gazetteer(spark, sf_dir):
    """C17: typed place names resolved against the history's junctions;
    blank or unknown names give NULL positions."""
    q = FX.fixture(spark, sf_dir, "place_queries")
    hist = processed(spark, sf_dir)
    return RD.gazetteer_lookup(q, gazetteer_df(spark, sf_dir), dashboards.bbox(hist))


_PLACE_SEARCH_SQL = r"""
, asked AS (SELECT query_id, query, CASE WHEN trim(query) <> '' THEN
    trim(regexp_replace(regexp_replace(lower(trim(query)), ',\s*bengaluru.*$', ''), '\s+', ' ', 'g')) END AS key FROM place_searches),
box AS (SELECT min(latitude) - 0.06 AS south, max(latitude) + 0.06 AS north, min(longitude) - 0.06 AS west,
  max(longitude) + 0.06 AS east FROM processed),
keys AS (SELECT key, list_filter(list_distinct(regexp_split_to_array(key, '[^a-z0-9]+')), lambda w: w <> '') AS ws
  FROM (SELECT DISTINCT key FROM asked WHERE key <> '') d),
known AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(pkey, '[^a-z0-9]+')), lambda w: w <> '') AS pws FROM (
  SELECT *, trim(regexp_replace(lower(trim(display_name)), '\s+', ' ', 'g')) AS pkey,
    CASE WHEN lat BETWEEN south AND north AND lon BETWEEN west AND east THEN 0 ELSE 1 END AS outside FROM places, box) p),
qwords AS (SELECT DISTINCT unnest(ws) AS w FROM keys), pwords AS (SELECT DISTINCT unnest(pws) AS p FROM known),
near AS (SELECT w, p, levenshtein(w, p) AS e FROM qwords, pwords
  WHERE levenshtein(w, p) <= CASE WHEN length(w) >= 8 THEN 2 WHEN length(w) >= 4 THEN 1 ELSE 0 END
    AND regexp_replace(w, '[^0-9]', '', 'g') = regexp_replace(p, '[^0-9]', '', 'g')),
names AS (SELECT DISTINCT pkey, pws FROM known),
by_words AS (SELECT key, pkey, sum(e) AS edits, greatest(any_value(m) - any_value(k), 0) AS missing FROM (
    SELECT key, pkey, a.w, any_value(k) AS k, any_value(m) AS m, min(e) AS e
    FROM (SELECT key, len(ws) AS k, unnest(ws) AS w FROM keys) a JOIN near USING (w)
      JOIN (SELECT pkey, len(pws) AS m, unnest(pws) AS p FROM names) b USING (p) GROUP BY key, pkey, a.w) t
  GROUP BY key, pkey HAVING count(*) = any_value(k)),
whole AS (SELECT key, pkey, levenshtein(key, pkey) AS edits, 0 AS missing FROM keys, names
  WHERE abs(length(key) - length(pkey)) <= 2
    AND levenshtein(key, pkey) <= CASE WHEN length(key) >= 8 THEN 2 WHEN length(key) >= 4 THEN 1 ELSE 0 END
    AND regexp_replace(key, '[^0-9]', '', 'g') = regexp_replace(pkey, '[^0-9]', '', 'g')),
best AS (SELECT key, edits, missing, lat, lon, display_name FROM (SELECT * FROM by_words UNION ALL SELECT * FROM whole) u
  JOIN known USING (pkey)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY edits, missing, outside, n DESC, display_name, lat, lon) = 1)
SELECT query_id, query, lat, lon, display_name, CAST(edits AS INT) AS edits, CAST(missing AS INT) AS missing
FROM asked LEFT JOIN best USING (key)"""


@register("place_search", processed_ctes("places", "place_searches") + _PLACE_SEARCH_SQL)
def q_place_search(spark, sf_dir):
    """C17: misspelt, partial and reordered place names against a place list."""
    return places.search_places(FX.fixture(spark, sf_dir, "place_searches"), FX.fixture(spark, sf_dir, "places"),
                                dashboards.bbox(processed(spark, sf_dir)))


REQUEST_COLS = "request_id, event_cause, event_type, lat, lon, when_ist, priority_override, requested_at, shift_id"


@register("load_requests", with_ctes(["requests"]) + f"SELECT {REQUEST_COLS} FROM requests")
def q_load_requests(spark, sf_dir):
    """Requests landed as CSV and read back with the explicit schema."""
    path = scratch_path(spark, f"requests_csv_{uuid.uuid4().hex[:10]}")
    (requests_df(spark, sf_dir).select(*reversed(REQUEST_COLS.split(", "))).write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
    return BR.load_requests(spark, path, "csv")


@register("briefing_text")
def q_briefing(spark, sf_dir):
    """A10: the text briefing of every forecast (deployment points from the
    geometric ring, as when no road graph is loaded)."""
    models, _, _ = trained(spark, sf_dir, with_metrics=False)
    fc = materialize(FC.forecast(requests_df(spark, sf_dir), stored_history(spark, sf_dir), models), "forecasts")
    plan = fc.select("request_id", "lat", "lon", F.col("barricades.barricade_points").alias("barricade_points"),
                     F.col("manpower.personnel").alias("personnel"))
    return BR.briefing_text(fc, spatial.deployment_points(plan))


@register("model_io_roundtrip")
def q_model_io(spark, sf_dir):
    """Saved models load back and score requests identically."""
    models, _, _ = trained(spark, sf_dir, with_metrics=False)
    req = requests_df(spark, sf_dir)
    base = scratch_path(spark, f"models_copy_{uuid.uuid4().hex[:10]}")
    ml.save_models(models, base)
    again = ml.load_models(base)
    feats = FC.dealt_for_scoring(materialize(FC.assemble_features(req, stored_history(spark, sf_dir), models), "model_io_features"))
    a = ml.predict_closure(models["closure_model"], feats.withColumn("priority", F.lit("High")))
    b = ml.predict_closure(again["closure_model"], feats.withColumn("priority", F.lit("High")))
    return a.select("request_id", F.col("closure_p").alias("p_saved")).join(
        b.select("request_id", F.col("closure_p").alias("p_loaded")), "request_id")


@register("metrics_log")
def q_metrics_log(spark, sf_dir):
    """Metrics appended per run and read back (empty when absent)."""
    _, metrics, _ = trained(spark, sf_dir)
    path = scratch_path(spark, f"metrics_log_{uuid.uuid4().hex[:10]}")
    assert ml.read_metrics(spark, path).isEmpty()
    ml.write_metrics(metrics, path)
    return ml.latest_run(ml.read_metrics(spark, path))


@register("retrain_with_feedback")
def q_retrain(spark, sf_dir):
    """Export + feedback log -> retrain -> new vs previous metrics."""
    _, old, _ = trained(spark, sf_dir)
    out = ml.retrain_with_feedback(raw_incidents(spark, sf_dir), fb.outcome_rows(outcomes_df(spark, sf_dir)), old,
                                   cleaning.prepare_incidents)
    return out[2]


from roadpulse.sources.incidents import read_processed, write_processed  # noqa: E402


@register("write_processed", processed_ctes() + f"""SELECT id, CAST(start_ts AS DATE) AS start_date, event_cause,
  {_r('duration_min')} AS duration_min, is_corridor FROM processed""")
def q_write_processed(spark, sf_dir):
    """A2: the processed table written as Parquet partitioned by local
    start date (rebalanced, sorted by time) and read back."""
    path = scratch_path(spark, f"processed_{uuid.uuid4().hex[:10]}")
    write_processed(processed(spark, sf_dir), path)
    back = read_processed(spark, path)
    return back.select("id", "start_date", "event_cause", F.round("duration_min", 6).alias("duration_min"),
                       "is_corridor")


# -------------------------------- what SQL can hold the training family against
@register("training_facts", processed_ctes(extra={
    "split_t": SPLIT_SQL,
    "tiers": f"SELECT *, {_TIER_SQL.format(m='duration_min')} AS tier FROM split_t WHERE duration_valid"}) + """
SELECT model, metric, round(value, 6) AS value FROM (
  SELECT 'all' AS model, 'n_total_events' AS metric, count(*)::DOUBLE AS value FROM split_t
  UNION ALL SELECT 'all', 'n_train', count(*) FROM split_t WHERE split = 'train'
  UNION ALL SELECT 'all', 'n_test', count(*) FROM split_t WHERE split = 'test'
  UNION ALL SELECT 'all', 'train_window_end_us', epoch_us(max(start_ts)) FROM split_t WHERE split = 'train'
  UNION ALL SELECT 'all', 'test_window_start_us', epoch_us(min(start_ts)) FROM split_t WHERE split = 'test'
  UNION ALL SELECT 'closure_model', 'positive_rate', avg(CAST(requires_road_closure AS DOUBLE)) FROM split_t WHERE split = 'test'
  UNION ALL SELECT 'priority_model', 'test_share_' || priority, count(*) / (SELECT count(*) FROM split_t WHERE split = 'test')
    FROM split_t WHERE split = 'test' GROUP BY priority
  UNION ALL SELECT 'duration_model', 'n_train_valid', count(*) FROM tiers WHERE split = 'train'
  UNION ALL SELECT 'duration_model', 'naive_baseline_mae_minutes', avg(abs(duration_min - (
    SELECT quantile_cont(duration_min, 0.5) FROM tiers WHERE split = 'train'))) FROM tiers WHERE split = 'test'
) facts""")
def q_training_facts(spark, sf_dir):
    """What the metrics of a training run say of its data."""
    _, metrics, _ = trained(spark, sf_dir)
    told = ["n_total_events", "n_train", "n_test", "train_window_end_us", "test_window_start_us", "positive_rate",
            "n_train_valid", "naive_baseline_mae_minutes"]
    return metrics.where(F.col("metric").isin(told) | F.col("metric").startswith("test_share_")).select(
        "model", "metric", F.round("value", 6).alias("value"))


@register("geo_cluster_assignment", with_ctes(["requests"]) + """
SELECT count(*) AS n_requests, CAST(0 AS BIGINT) AS not_at_nearest, CAST(50 AS BIGINT) AS n_centres FROM requests""")
def q_geo_cluster_assignment(spark, sf_dir):
    """Requests whose cluster is not that of their nearest centre (none)."""
    km = geo_model(spark, sf_dir)
    centres = [tuple(float(x) for x in c) for c in km.clusterCenters()]
    req = requests_df(spark, sf_dir).withColumns({"latitude": F.col("lat"), "longitude": F.col("lon")})
    placed = ml.assign_geo_cluster(km, req)
    apart = F.array(*[F.pow(F.col("lat") - a, 2) + F.pow(F.col("lon") - b, 2) for a, b in centres])
    own = F.element_at(apart, F.col("geo_cluster").cast("int") + 1)
    return placed.agg(F.count("*").alias("n_requests"),
                      F.count(F.when(own > F.array_min(apart) + 1e-12, 1)).alias("not_at_nearest")).withColumn(
        "n_centres", F.lit(len(centres)).cast("long"))


@register("model_io_differences", with_ctes(["requests"]) + """
SELECT count(*) AS n_requests, CAST(0 AS BIGINT) AS n_different FROM requests""")
def q_model_io_differences(spark, sf_dir):
    """Requests that saved and loaded models score differently (none)."""
    return q_model_io(spark, sf_dir).agg(
        F.count("*").alias("n_requests"), F.count(F.when(~F.col("p_saved").eqNullSafe(F.col("p_loaded")), 1)).alias("n_different"))


@register("register_clear", with_ctes(["register"]) + f"""SELECT count(*) AS n_before,
  CAST(0 AS BIGINT) AS n_after FROM register""")
def q_register_clear(spark, sf_dir):
    """rows of the register before and after it is cleared."""
    reg = register_df(spark, sf_dir)
    return reg.agg(F.count("*").alias("n_before")).join(reg_ops.clear(reg).agg(F.count("*").alias("n_after")), how="cross")


@register("allocation_totals", with_ctes(["register"], {"avail": _AVAILABLE_SQL}) + """
SELECT shift_id, CAST(sum(personnel) AS BIGINT) AS needed, CAST(sum(allocated) AS BIGINT) AS allocated,
  CAST(sum(greatest(personnel - allocated, 0)) AS BIGINT) AS short FROM (
  SELECT *, CAST(CASE WHEN pos = n THEN greatest(available - before, 0)
                      ELSE least(greatest(available - before, 0), want) END AS BIGINT) AS allocated FROM (
    SELECT *, coalesce(sum(want) OVER (PARTITION BY shift_id ORDER BY impact_score DESC, id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (PARTITION BY shift_id ORDER BY impact_score DESC, id) AS pos FROM (
      SELECT r.*, a.available, count(*) OVER (PARTITION BY r.shift_id) AS n,
        greatest(1, CAST(round_even(a.available * r.impact_score /
          CASE WHEN sum(r.impact_score) OVER (PARTITION BY r.shift_id) = 0 THEN 1e0
               ELSE sum(r.impact_score) OVER (PARTITION BY r.shift_id) END, 0) AS BIGINT)) AS want
      FROM register r JOIN avail a ON a.shift_id = r.shift_id WHERE r.status = 'active' AND a.available > 0) x) y) z
GROUP BY shift_id""")
def q_allocation_totals(spark, sf_dir):
    """officers needed, placed and short in each shift."""
    return q_allocation(spark, sf_dir).groupBy("shift_id").agg(
        F.sum("personnel").cast("long").alias("needed"), F.sum("allocated").cast("long").alias("allocated"),
        F.sum("shortfall").cast("long").alias("short"))


@register("forecast_attached")
def q_forecast_attached(spark, sf_dir):
    """F17 with everything attached: road diversions, the weather as of each
    request, and a history that includes the logged outcomes."""
    models, _, _ = trained(spark, sf_dir, with_metrics=False)
    req = requests_df(spark, sf_dir)
    history = materialize(cleaning.prepare_incidents(fb.augment_with_feedback(
        raw_incidents(spark, sf_dir), fb.outcome_rows(outcomes_df(spark, sf_dir)))), "history_with_feedback")
    roads = materialize(RD.diversion_routes(req.select("request_id", "lat", "lon"), road_nodes(spark, sf_dir),
                                            road_edges(spark, sf_dir)), "road_diversions")
    weather = materialize(W.weather_asof_join(req, weather_df(spark, sf_dir)), "weather_as_of")
    out = FC.forecast(req, history, models, road_diversions=roads, weather=weather)
    return FC.flatten_forecast(out).join(out.select(
        "request_id", F.round("weather_adjusted_closure", 6).alias("weather_adjusted_closure"), F.col("diversion.approach_count").alias("approach_count"),
        F.col("diversion.suggested_routes").alias("suggested_routes"), F.col("diversion.note").alias("diversion_note"),
        F.col("anomaly.anomaly_n").alias("anomaly_n"), F.col("anomaly.is_elevated").alias("is_elevated"),
        F.col("anomaly.is_suppressed").alias("is_suppressed")), "request_id")
