"""DuckDB oracle SQL for the query catalog.

Each text runs on DuckDB with the driver's tables as views.  Fixture CTEs
come from the same SQL as the Spark side (``sources.fixtures``); the query
logic itself is written independently in plain SQL (brute force where the
Spark side uses grids, sorts where it uses closed forms) so agreement is a
real check.
"""
from __future__ import annotations

from roadpulse.constants import (
    BASE_PERSONNEL, DEFAULT_BASE_PERSONNEL, FESTIVAL_WINDOWS, RAIN_SENSITIVE, WMO_DESCRIPTIONS, WMO_OTHER,
)
from roadpulse.sources.fixtures import FIXTURES, DUCKDB

_FESTIVAL = " OR ".join(f"CAST(start_ts AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in FESTIVAL_WINDOWS)

CLEAN_SQL = """SELECT id, latitude, longitude, address, status, junction,
  CASE WHEN trim(coalesce(event_cause, 'others')) = 'Debris' THEN 'debris'
       ELSE trim(coalesce(event_cause, 'others')) END AS event_cause,
  coalesce(event_type, 'unplanned') AS event_type,
  coalesce(priority, 'Low') AS priority,
  coalesce(police_station, 'Unknown') AS police_station,
  coalesce(zone, 'Unknown') AS zone,
  coalesce(requires_road_closure, false) AS requires_road_closure,
  coalesce(corridor, 'Non-corridor') AS corridor,
  start_datetime, end_datetime, created_date, closed_datetime, resolved_datetime,
  start_datetime + INTERVAL 330 MINUTE AS start_ts
FROM incidents"""

PROCESSED_SQL = f"""SELECT *,
  coalesce(duration_min > 0 AND duration_min < 2880, false) AS duration_valid
FROM (SELECT *,
  hour(start_ts) AS hour,
  isodow(start_ts) - 1 AS dow,
  dayname(start_ts) AS dow_name,
  month(start_ts) AS month,
  CASE WHEN isodow(start_ts) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
  sin(2*pi()*coalesce(hour(start_ts), 0)/24e0) AS hour_sin,
  cos(2*pi()*coalesce(hour(start_ts), 0)/24e0) AS hour_cos,
  sin(2*pi()*coalesce(isodow(start_ts) - 1, 0)/7e0) AS dow_sin,
  cos(2*pi()*coalesce(isodow(start_ts) - 1, 0)/7e0) AS dow_cos,
  CASE WHEN hour(start_ts) <= 4 THEN 'Late Night (00-04)' WHEN hour(start_ts) <= 7 THEN 'Early Morning (04-07)'
       WHEN hour(start_ts) <= 10 THEN 'Morning (07-10)' WHEN hour(start_ts) <= 16 THEN 'Midday (10-16)'
       WHEN hour(start_ts) <= 19 THEN 'Evening (16-19)' WHEN hour(start_ts) <= 22 THEN 'Night Peak (19-22)'
       ELSE 'Late Night (22-24)' END AS daypart,
  CASE WHEN {_FESTIVAL} THEN 1 ELSE 0 END AS is_festival_window,
  date_diff('microsecond', start_datetime, coalesce(resolved_datetime, closed_datetime, end_datetime)) / 6e7
    AS duration_min,
  CASE WHEN corridor <> 'Non-corridor' THEN 1 ELSE 0 END AS is_corridor
FROM ({CLEAN_SQL}) c
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND start_ts IS NOT NULL) t"""

RAW_PARSED_SQL = """SELECT id, event_type, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude,
  address, event_cause, status, priority, corridor, police_station,
  CASE WHEN zone NOT IN ('NULL', 'NA') THEN zone END AS zone, junction,
  coalesce(lower(trim(requires_road_closure)) IN ('true', '1', 'yes', '1.0', 't', 'y'), false) AS requires_road_closure,
  TRY_CAST(start_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS start_datetime,
  TRY_CAST(end_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS end_datetime,
  TRY_CAST(created_date AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS created_date,
  TRY_CAST(closed_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS closed_datetime,
  TRY_CAST(resolved_datetime AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS resolved_datetime
FROM incidents_raw"""

BASE_PERSONNEL_VALUES = ", ".join(f"('{k}', {v})" for k, v in BASE_PERSONNEL.items())


def with_ctes(fixtures, extra: dict[str, str] | None = None) -> str:
    parts = [f"{n} AS ({FIXTURES[n](DUCKDB)})" for n in fixtures]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


def processed_ctes(*more_fixtures, extra: dict[str, str] | None = None) -> str:
    ex = {"processed": PROCESSED_SQL}
    ex.update(extra or {})
    return with_ctes(["incidents", *more_fixtures], ex)


def _r(expr: str, d: int = 6) -> str:
    return f"round({expr}, {d})"


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Haversine km, same operation order as ``functions.geo.haversine_km``."""
    return (f"(12742e0 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * "
            f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))")


# brute-force k nearest: every request against every history row
KNN5_SQL = f"""SELECT * FROM (
  SELECT r.request_id, h.id AS hid, h.corridor, h.police_station, h.zone, h.is_corridor,
         {hav_sql('r.lat', 'r.lon', 'h.latitude', 'h.longitude')} AS distance_km
  FROM requests r CROSS JOIN processed h) t
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY distance_km, hid) <= 5"""


def _mode_sql(col: str) -> str:
    return f"""(SELECT request_id, {col} FROM (SELECT request_id, {col}, count(*) AS c FROM knn5
  WHERE {col} IS NOT NULL GROUP BY request_id, {col}) t
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY c DESC, {col}) = 1)"""


CONTEXT_SQL = f"""SELECT b.request_id, mc.corridor, mp.police_station, mz.zone, CAST(mi.is_corridor AS INT) AS is_corridor,
  b.nearest_distance_km, b.n_neighbors_used
FROM (SELECT request_id, min(distance_km) AS nearest_distance_km, CAST(count(*) AS INT) AS n_neighbors_used
      FROM knn5 GROUP BY request_id) b
LEFT JOIN {_mode_sql('corridor')} mc ON b.request_id = mc.request_id
LEFT JOIN {_mode_sql('police_station')} mp ON b.request_id = mp.request_id
LEFT JOIN {_mode_sql('zone')} mz ON b.request_id = mz.request_id
LEFT JOIN {_mode_sql('is_corridor')} mi ON b.request_id = mi.request_id"""

SIMILAR_SQL = f"""SELECT * FROM (
  SELECT r.request_id, h.id AS hid, h.event_cause, h.corridor, h.duration_min, h.duration_valid,
         h.requires_road_closure, h.start_ts, h.address, h.priority,
         {hav_sql('r.lat', 'r.lon', 'h.latitude', 'h.longitude')} AS distance_km
  FROM requests r
  JOIN (SELECT event_cause, count(*) AS n FROM processed GROUP BY event_cause) cn ON TRUE
  JOIN processed h ON (CASE WHEN EXISTS (SELECT 1 FROM processed p2 WHERE p2.event_cause = r.event_cause
                                         GROUP BY p2.event_cause HAVING count(*) >= 3)
                            THEN h.event_cause = r.event_cause ELSE TRUE END)
  WHERE cn.event_cause = h.event_cause) t
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY distance_km, hid) <= 8"""
