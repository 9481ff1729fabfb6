"""Stand-in inputs derived from the driver's read-only tables.

The reference's own incident export is not available, so every input table
is derived row-for-row from ``events`` (and ``part`` for the road lattice)
by SQL expressions that Spark and DuckDB evaluate identically.  The same SQL
text feeds both engines: Spark runs it through ``spark.sql`` over the parquet
files, and the DuckDB oracle inlines it as a CTE.  Only timestamp arithmetic
differs between the dialects and is injected through ``_ts_add_minutes`` etc.

These builders only shape rows into the schemas the jobs expect; they do none
of the jobs' work (no cleaning, parsing, scoring or ranking happens here).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK, DUCKDB = "spark", "duckdb"

SOURCE_TABLES = ("events", "part")


# ---------------------------------------------------------------- dialect bits
def _ts_add_minutes(ts: str, minutes: str, dialect: str) -> str:
    micros = f"CAST(round(({minutes})*6e7) AS BIGINT)"
    if dialect == SPARK:
        return f"timestampadd(MICROSECOND, {micros}, {ts})"
    return f"({ts} + to_microseconds({micros}))"


def _ts_add_days(ts: str, days: int, dialect: str) -> str:
    if dialect == SPARK:
        return f"timestampadd(DAY, {days}, {ts})"
    return f"({ts} + INTERVAL {days} DAY)"


def _ts_literal(text: str, dialect: str) -> str:
    return f"TIMESTAMP_NTZ '{text}'" if dialect == SPARK else f"TIMESTAMP '{text}'"


def _fmt_ms_plus00(ts: str, dialect: str) -> str:
    if dialect == SPARK:
        return f"(date_format({ts}, 'yyyy-MM-dd HH:mm:ss.SSS') || '+00')"
    return f"(strftime({ts}, '%Y-%m-%d %H:%M:%S.%g') || '+00')"


def _fmt_iso_z(ts: str, dialect: str) -> str:
    if dialect == SPARK:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def _hour_trunc(ts: str, dialect: str) -> str:
    if dialect == SPARK:
        return f"CAST(date_trunc('HOUR', {ts}) AS TIMESTAMP_NTZ)"
    return f"date_trunc('hour', {ts})"


# ------------------------------------------------------------- shared columns
_HUB = "(user_id % 12)"
_CI = "((event_id*13 + user_id*5) % 16)"

LATITUDE = "(12.86e0 + 7e-2*(hub % 4) + ((event_id*7919) % 100003)*6e-7 - 3e-2)"
LONGITUDE = "(77.48e0 + 9e-2*((hub - hub % 4)/4) + ((event_id*104729) % 100003)*6e-7 - 3e-2)"

RAW_CAUSE = """CASE WHEN event_id IN (0, 977) THEN 'rare_cause'
  WHEN ci IN (0, 1) THEN 'vehicle_breakdown' WHEN ci = 2 THEN 'accident'
  WHEN ci = 3 THEN 'construction' WHEN ci = 4 THEN 'pot_holes'
  WHEN ci = 5 THEN 'tree_fall' WHEN ci = 6 THEN 'water_logging'
  WHEN ci = 7 THEN 'public_event' WHEN ci = 8 THEN 'procession'
  WHEN ci = 9 THEN 'vip_movement' WHEN ci = 10 THEN 'protest'
  WHEN ci = 11 THEN 'congestion' WHEN ci = 12 THEN 'Debris'
  WHEN ci = 13 THEN ' debris ' WHEN ci = 14 THEN 'road_conditions'
  ELSE NULL END"""

# the cause a dispatcher would pick from the form's option list
REQUEST_CAUSE = """CASE WHEN event_id % 1009 = 977 THEN 'rare_cause'
  WHEN ci IN (0, 1) THEN 'vehicle_breakdown' WHEN ci = 2 THEN 'accident'
  WHEN ci = 3 THEN 'construction' WHEN ci = 4 THEN 'pot_holes'
  WHEN ci = 5 THEN 'tree_fall' WHEN ci = 6 THEN 'water_logging'
  WHEN ci = 7 THEN 'public_event' WHEN ci = 8 THEN 'procession'
  WHEN ci = 9 THEN 'vip_movement' WHEN ci = 10 THEN 'protest'
  WHEN ci = 11 THEN 'congestion' WHEN ci IN (12, 13) THEN 'debris'
  WHEN ci = 14 THEN 'road_conditions' ELSE 'others' END"""

CLOSURE_RATE = """CASE WHEN ci IN (0, 1) THEN 2 WHEN ci = 2 THEN 6 WHEN ci = 3 THEN 30
  WHEN ci = 5 THEN 45 WHEN ci = 6 THEN 20 WHEN ci = 7 THEN 60 WHEN ci = 8 THEN 70
  WHEN ci = 9 THEN 80 WHEN ci = 10 THEN 50 ELSE 5 END"""

EVENT_TYPE = "CASE WHEN event_id % 301 = 0 THEN NULL WHEN ci IN (3, 7, 8, 9, 10) THEN 'planned' ELSE 'unplanned' END"
PRIORITY = "CASE WHEN event_id % 211 = 0 THEN NULL WHEN (hub < 8) = (event_id % 500 <> 7) THEN 'High' ELSE 'Low' END"
CORRIDOR = "CASE WHEN hub < 8 THEN 'Corridor ' || CAST(hub AS STRING) END"
POLICE_STATION = "'PS ' || CAST(user_id % 20 AS STRING)"
ZONE = "CASE WHEN event_id % 100 >= 58 THEN 'Zone ' || CAST(hub % 5 AS STRING) END"
JUNCTION = "CASE WHEN event_id % 100 >= 69 THEN 'Hub' || chr(CAST(65 + hub AS INT)) || 'MainJunc' END"
CLOSURE = f"CASE WHEN event_id % 401 = 0 THEN NULL ELSE ((event_id*31 + user_id*17) % 100) < ({CLOSURE_RATE}) END"
RESOLVED_MIN = """CASE WHEN event_type IN ('error', 'click') THEN
    CASE WHEN event_id % 97 = 0 THEN -5e0 WHEN event_id % 89 = 0 THEN 3e3 ELSE value END END"""
CLOSED_MIN = "CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 15e-1*value END"
END_MIN = "CASE WHEN ci IN (3, 7) AND event_id % 2 = 0 THEN 12e1 END"
STATUS = "CASE WHEN event_type IN ('error', 'click') THEN 'resolved' ELSE 'open' END"
ADDRESS = "'Road ' || CAST(event_id % 50 AS STRING)"

# quotes, commas and line breaks, as addresses in real exports have them
RAW_ADDRESS = f"""CASE WHEN event_id % 40 = 7 THEN 'Near "Big" shop, MG Road'
  WHEN event_id % 40 = 9 THEN 'Gate 2,' || chr(10) || 'Ring "Road' ELSE {ADDRESS} END"""

_BASE = f"SELECT *, {_HUB} AS hub, {_CI} AS ci FROM events"


def incidents_sql(dialect: str) -> str:
    """Typed incident history: 18 export columns, UTC timestamps (naive)."""
    add = lambda m: _ts_add_minutes("ts", m, dialect)
    return f"""SELECT
  'ev-' || CAST(event_id AS STRING) AS id,
  {EVENT_TYPE} AS event_type,
  {LATITUDE} AS latitude,
  {LONGITUDE} AS longitude,
  {ADDRESS} AS address,
  {RAW_CAUSE} AS event_cause,
  {CLOSURE} AS requires_road_closure,
  ts AS start_datetime,
  {add(END_MIN)} AS end_datetime,
  {STATUS} AS status,
  {PRIORITY} AS priority,
  {CORRIDOR} AS corridor,
  ts AS created_date,
  {POLICE_STATION} AS police_station,
  {add(CLOSED_MIN)} AS closed_datetime,
  {add(RESOLVED_MIN)} AS resolved_datetime,
  {ZONE} AS zone,
  {JUNCTION} AS junction
FROM ({_BASE}) b"""


def incidents_raw_sql(dialect: str) -> str:
    """The export as text: mixed timestamp formats, blanks, two surplus columns."""
    add = lambda m: _ts_add_minutes("ts", m, dialect)
    iso = lambda t: _fmt_iso_z(t, dialect)
    start = (f"CASE WHEN event_id % 70 = 13 THEN 'not-a-date' "
             f"WHEN event_id % 2 = 0 THEN {_fmt_ms_plus00('ts', dialect)} ELSE {iso('ts')} END")
    return f"""SELECT
  'ev-' || CAST(event_id AS STRING) AS id,
  {EVENT_TYPE} AS event_type,
  CASE WHEN event_id % 333 = 5 THEN NULL ELSE CAST({LATITUDE} AS STRING) END AS latitude,
  CAST({LONGITUDE} AS STRING) AS longitude,
  {RAW_ADDRESS} AS address,
  {RAW_CAUSE} AS event_cause,
  CASE WHEN event_id % 401 = 0 THEN NULL WHEN ((event_id*31 + user_id*17) % 100) < ({CLOSURE_RATE})
       THEN 'TRUE' ELSE 'FALSE' END AS requires_road_closure,
  {start} AS start_datetime,
  {iso(add(END_MIN))} AS end_datetime,
  {STATUS} AS status,
  {PRIORITY} AS priority,
  {CORRIDOR} AS corridor,
  {iso('ts')} AS created_date,
  {POLICE_STATION} AS police_station,
  {iso(add(CLOSED_MIN))} AS closed_datetime,
  {iso(add(RESOLVED_MIN))} AS resolved_datetime,
  CASE WHEN event_id % 100 = 60 THEN 'NULL' WHEN event_id % 100 = 61 THEN 'NA' ELSE {ZONE} END AS zone,
  {JUNCTION} AS junction,
  'n/a' AS comment,
  CAST(event_id % 7 AS STRING) AS map_file
FROM ({_BASE}) b"""


def requests_sql(dialect: str) -> str:
    """Scenario requests: every event re-posed 30 days later, nudged 1e-3
    degrees, plus the two fixed points of the reference's own tests."""
    lit = lambda t: _ts_literal(t, dialect)
    return f"""SELECT
  'rq-' || CAST(event_id AS STRING) AS request_id,
  {REQUEST_CAUSE} AS event_cause,
  CASE WHEN ci IN (3, 7, 8, 9, 10) THEN 'planned' ELSE 'unplanned' END AS event_type,
  {LATITUDE} + 1e-3 AS lat,
  {LONGITUDE} + 1e-3 AS lon,
  {_ts_add_days('ts', 30, dialect)} AS when_ist,
  CASE WHEN event_id % 60 = 3 THEN 'Low' END AS priority_override,
  ts AS requested_at,
  CAST(user_id % 4 AS INT) AS shift_id
FROM ({_BASE}) b
UNION ALL SELECT 'rq-test-silkboard', 'vehicle_breakdown', 'unplanned', 12.9352e0, 77.6146e0,
  {lit('2026-07-01 09:00:00')}, CAST(NULL AS STRING), {lit('2024-01-15 06:00:00')}, 0
UNION ALL SELECT 'rq-test-far', 'public_event', 'planned', 13.2e0, 77.85e0,
  {lit('2026-08-15 18:00:00')}, CAST(NULL AS STRING), {lit('2024-01-20 12:00:00')}, 1"""


def register_sql(dialect: str) -> str:
    """Active-events register rows as added from forecasts."""
    score = "((event_id*7919) % 1001)/1e1"
    band = (f"CASE WHEN {score} < 25e0 THEN 'Low' WHEN {score} < 50e0 THEN 'Medium' "
            f"WHEN {score} < 75e0 THEN 'High' ELSE 'Critical' END")
    color = (f"CASE WHEN {score} < 25e0 THEN '#34D399' WHEN {score} < 50e0 THEN '#F5A623' "
             f"WHEN {score} < 75e0 THEN '#F2784B' ELSE '#E5484D' END")
    return f"""SELECT
  'rg-' || CAST(event_id AS STRING) AS id,
  {REQUEST_CAUSE} AS cause,
  CASE WHEN ci IN (3, 7, 8, 9, 10) THEN 'planned' ELSE 'unplanned' END AS event_type,
  {LATITUDE} + 1e-3 AS lat,
  {LONGITUDE} + 1e-3 AS lon,
  'Loc ' || CAST(event_id AS STRING) AS location_name,
  {_ts_add_days('ts', 30, dialect)} AS when_ist,
  {score} AS impact_score,
  {band} AS band,
  {color} AS color,
  ((event_id*31) % 100)/1e2 AS closure_prob,
  CAST(1 + event_id % 7 AS INT) AS personnel,
  CAST(event_id % 5 AS INT) AS barricades,
  CASE WHEN hub < 8 THEN 'Corridor ' || CAST(hub AS STRING) ELSE 'Non-corridor' END AS corridor,
  {POLICE_STATION} AS police_station,
  CASE WHEN hub < 8 THEN 'High' ELSE 'Low' END AS priority,
  CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status,
  ts AS added_at,
  CAST(user_id % 4 AS INT) AS shift_id
FROM ({_BASE}) b"""


def scores_sql(dialect: str) -> str:
    """Scored hold-out rows for the metric operators (labels + predictions);
    some scores are missing, no number, or outside of [0, 1]."""
    return f"""SELECT
  'ev-' || CAST(event_id AS STRING) AS id,
  CASE WHEN ({CLOSURE}) THEN 1 ELSE 0 END AS label,
  CASE WHEN event_id % 83 = 5 THEN NULL WHEN event_id % 89 = 7 THEN CAST('NaN' AS DOUBLE)
       WHEN event_id % 97 = 9 THEN 15e-1 WHEN event_id % 101 = 11 THEN -25e-2
       ELSE ((event_id*53 + user_id*7) % 100)/1e2 END AS score,
  value AS actual_min,
  value + (event_id % 11) - 5 AS pred_min
FROM ({_BASE}) b"""


def outcomes_sql(dialect: str) -> str:
    """Resolved-event outcome submissions (input of ``log_outcomes``)."""
    iso = lambda t: _fmt_iso_z(t, dialect)
    return f"""SELECT
  {REQUEST_CAUSE} AS event_cause,
  CASE WHEN ci IN (3, 7, 8, 9, 10) THEN 'planned' ELSE 'unplanned' END AS event_type,
  {LATITUDE} AS lat,
  {LONGITUDE} AS lon,
  {ADDRESS} AS address,
  CASE WHEN hub < 8 THEN 'High' ELSE 'Low' END AS priority,
  CASE WHEN hub < 8 THEN 'Corridor ' || CAST(hub AS STRING) ELSE 'Non-corridor' END AS corridor,
  {POLICE_STATION} AS police_station,
  {iso('ts')} AS start_datetime,
  {iso(_ts_add_minutes('ts', 'value + 1e0', dialect))} AS actual_end_datetime,
  ((event_id*31 + user_id*17) % 100) < ({CLOSURE_RATE}) AS requires_road_closure,
  CAST(1 + event_id % 9 AS INT) AS manpower_used,
  ((event_id*7919) % 1001)/1e1 AS forecast_impact_score,
  event_id % 4 = 1 AS escalated_beyond_forecast,
  'outcome ' || CAST(event_id AS STRING) AS notes
FROM ({_BASE}) b"""


def weather_payloads_sql(dialect: str) -> str:
    """Landed weather API bodies, one per distinct hour of the events, in the
    two provider shapes; some values missing and one body malformed."""
    hour_ts = _hour_trunc("ts", dialect)
    code = ("CASE hr % 8 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 45 WHEN 3 THEN 51 "
            "WHEN 4 THEN 61 WHEN 5 THEN 80 WHEN 6 THEN 95 ELSE 22 END")
    mm = ("CASE hr % 8 WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN '0' WHEN 3 THEN '0.4' "
          "WHEN 4 THEN '3' WHEN 5 THEN '7' WHEN 6 THEN '12' ELSE '0' END")
    desc = ("CASE hr % 8 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Partly cloudy' WHEN 2 THEN 'Mist' "
            "WHEN 3 THEN 'Light drizzle' WHEN 4 THEN 'Moderate rain' WHEN 5 THEN 'Heavy rain' "
            "WHEN 6 THEN 'Thundery outbreaks' ELSE 'Patchy rain nearby' END")
    temp = "CASE WHEN hr % 11 = 4 THEN 'null' ELSE CAST(20 + hr % 13 AS STRING) END"
    wind = "CAST(5 + hr % 17 AS STRING)"
    om = ("'{\"current\": {\"precipitation\": ' || " + mm + " || ', \"weathercode\": ' || CAST(" + code +
          " AS STRING) || ', \"temperature_2m\": ' || " + temp + " || ', \"windspeed_10m\": ' || " + wind + " || '}}'")
    wt = ("'{\"current_condition\": [{\"precipMM\": \"' || " + mm + " || '\", \"temp_C\": \"' || " + temp +
          " || '\", \"windspeedKmph\": \"' || " + wind + " || '\", \"weatherCode\": \"' || CAST(113 + hr % 8 AS STRING)"
          " || '\", \"weatherDesc\": [{\"value\": \"' || " + desc + " || '\"}]}]}'")
    return f"""SELECT
  CASE WHEN hr % 3 = 2 THEN 'wttr' ELSE 'open_meteo' END AS source,
  received_at,
  CASE WHEN hr % 97 = 50 THEN '{{not json'
       WHEN hr % 3 = 2 THEN {wt} ELSE {om} END AS body
FROM (SELECT received_at, CAST(hour(received_at) + 24*dayofmonth(received_at) AS BIGINT) AS hr
      FROM (SELECT DISTINCT {hour_ts} AS received_at FROM events) h) p"""


def road_nodes_sql(dialect: str) -> str:
    """Lattice junctions 20 wide, ~100 m apart, from ``part`` keys."""
    return """SELECT p_partkey AS node_id,
  12.97e0 + 8.983e-4*((p_partkey - p_partkey % 20)/20) AS lat,
  77.59e0 + 9.22e-4*(p_partkey % 20) AS lon
FROM part"""


def road_edges_sql(dialect: str) -> str:
    """Directed lattice edges both ways to the right and lower neighbour, with
    a parallel second edge on some pairs; nodes with key % 997 = 500 are left
    isolated."""
    return """SELECT src, dst, key, length, name FROM (
  SELECT p_partkey AS src, p_partkey + 1 AS dst, 0 AS key, 1e2 + (p_partkey*37) % 50 AS length,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Row ' || CAST((p_partkey - p_partkey % 20)/20 AS BIGINT) END AS name,
         p_partkey AS a, p_partkey + 1 AS b
    FROM part WHERE p_partkey % 20 <> 19
  UNION ALL
  SELECT p_partkey + 1, p_partkey, 0, 1e2 + (p_partkey*37) % 50,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Row ' || CAST((p_partkey - p_partkey % 20)/20 AS BIGINT) END,
         p_partkey, p_partkey + 1
    FROM part WHERE p_partkey % 20 <> 19
  UNION ALL
  SELECT p_partkey, p_partkey + 1, 1, 1e2 + (p_partkey*37) % 50 + 5e0,
         'Alt ' || CAST((p_partkey - p_partkey % 20)/20 AS BIGINT), p_partkey, p_partkey + 1
    FROM part WHERE p_partkey % 20 <> 19 AND p_partkey % 13 = 0
  UNION ALL
  SELECT p_partkey, p_partkey + 20, 0, 1e2 + (p_partkey*41) % 50,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Col ' || CAST(p_partkey % 20 AS STRING) END,
         p_partkey, p_partkey + 20
    FROM part WHERE p_partkey + 20 IN (SELECT p_partkey FROM part)
  UNION ALL
  SELECT p_partkey + 20, p_partkey, 0, 1e2 + (p_partkey*41) % 50,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Col ' || CAST(p_partkey % 20 AS STRING) END,
         p_partkey, p_partkey + 20
    FROM part WHERE p_partkey + 20 IN (SELECT p_partkey FROM part)
) e WHERE a % 997 <> 500 AND b % 997 <> 500"""


def place_queries_sql(dialect: str) -> str:
    """Typed place-name lookups, as a user would type them: junction names
    spelled out, in varied case, some with the city appended, some blank."""
    return f"""SELECT 'pq-' || CAST(event_id AS STRING) AS query_id,
  CASE WHEN event_id % 7 = 0 THEN '   '
       WHEN event_id % 7 = 1 THEN 'Hub ' || chr(CAST(65 + hub AS INT)) || ' Main Junction'
       WHEN event_id % 7 = 2 THEN lower('Hub ' || chr(CAST(65 + hub AS INT)) || ' Main Junction') || ', Bengaluru'
       WHEN event_id % 7 = 3 THEN 'Nowhere Street ' || CAST(event_id % 13 AS STRING)
       ELSE upper('hub ' || chr(CAST(65 + hub AS INT)) || ' main junction') END AS query
FROM ({_BASE}) b"""


def places_sql(dialect: str) -> str:
    """A place list: a named road at every lattice junction, some names shared."""
    return f"""SELECT r.node_id, p_name || ' ' || lower(p_type) || ' Road ' || substr(p_brand, 7) AS display_name,
  r.lat, r.lon, CAST(p_size AS BIGINT) AS n FROM ({road_nodes_sql(dialect)}) r JOIN part ON p_partkey = r.node_id"""


def place_searches_sql(dialect: str) -> str:
    """Place names as people type them, one per place: whole, reordered and
    partial names, a letter left out or replaced, blanks forgotten, one word
    alone, names of nowhere and blanks."""
    i = "CAST(1 + node_id % 11 AS INT)"
    return f"""SELECT 'ps-' || CAST(node_id AS STRING) AS query_id, CASE node_id % 10
    WHEN 0 THEN '  '
    WHEN 1 THEN upper(display_name)
    WHEN 2 THEN 'road ' || substr(p_brand, 7) || ' ' || p_name
    WHEN 3 THEN substr(display_name, 1, {i} - 1) || substr(display_name, {i} + 1)
    WHEN 4 THEN substr(display_name, 1, {i} - 1) || 'x' || substr(display_name, {i} + 1)
    WHEN 5 THEN p_name || ' ' || substr(p_type, 2) || ', Bengaluru'
    WHEN 6 THEN replace(p_name, ' ', '') || ' ' || lower(p_type) || ' Raod ' || substr(p_brand, 7)
    WHEN 7 THEN 'Nowhere Lane ' || CAST(node_id % 13 AS STRING)
    WHEN 8 THEN substr(p_name, 1 + instr(p_name, ' '))
    ELSE lower(p_type) || '  ' || substr(p_name, 1, instr(p_name, ' ') - 1) || 's' END AS query
FROM ({places_sql(dialect)}) l JOIN part ON p_partkey = l.node_id"""


def scenario_scores_sql(dialect: str) -> str:
    """Requests with stand-in model outputs (closure probability, duration
    estimate, suggested priority) and context, so the scoring rules can be
    checked without trained models.  A few estimates are NULL, negative or
    beyond two days on purpose."""
    a = "CAST(floor(lat*1e4) AS BIGINT)"
    b = "CAST(floor(lon*1e4) AS BIGINT)"
    c = "CAST(floor(lon*1e3) AS BIGINT)"
    d = "CAST(floor(lat*1e5) AS BIGINT)"
    return f"""SELECT request_id, event_cause, event_type, lat, lon, when_ist, priority_override, requested_at, shift_id,
  (({a}*31 + {b}) % 100)/1e2 AS closure_p,
  CASE WHEN {d} % 50 = 0 THEN NULL WHEN {d} % 50 = 1 THEN 3e3 WHEN {d} % 50 = 2 THEN -1e0
       ELSE CAST({d} % 700 AS DOUBLE) + 5e-1 END AS ml_duration_min,
  CASE WHEN {c} % 3 = 0 THEN 'Non-corridor' ELSE 'Corridor ' || CAST({c} % 8 AS STRING) END AS corridor,
  CASE WHEN {c} % 3 = 0 THEN 0 ELSE 1 END AS is_corridor,
  CASE WHEN ({a} + {b}) % 4 = 0 THEN 'Low' ELSE 'High' END AS suggested_priority
FROM ({requests_sql(dialect)}) r"""


FIXTURES = {
    "scenario_scores": scenario_scores_sql,
    "incidents": incidents_sql,
    "incidents_raw": incidents_raw_sql,
    "requests": requests_sql,
    "register": register_sql,
    "scores": scores_sql,
    "outcomes": outcomes_sql,
    "weather_payloads": weather_payloads_sql,
    "road_nodes": road_nodes_sql,
    "road_edges": road_edges_sql,
    "place_queries": place_queries_sql,
    "places": places_sql,
    "place_searches": place_searches_sql,
}


def register_sources(spark: SparkSession, sf_dir: str) -> None:
    """Expose the driver tables as temp views (lazy parquet scans)."""
    for name in SOURCE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one stand-in table over the parquet files of ``sf_dir``."""
    register_sources(spark, sf_dir)
    return spark.sql(FIXTURES[name](SPARK))
