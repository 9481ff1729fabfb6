"""Fixed values.

FIXED VALUES: everything in this module must equal the behaviour being
reproduced (festival dates, labels, weights, bands, personnel table, weather
code ranges).  They are stated once here, in natural order, and every
operator reads them from here.
"""
from __future__ import annotations

# --- fixed values: texts that a CSV export means as missing --------------------
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# --- fixed values: time ------------------------------------------------------
LOCAL_TZ = "Asia/Kolkata"

# first and last local date of each festival period
FESTIVAL_WINDOWS = [
    ("2023-11-10", "2023-11-15"),
    ("2023-12-24", "2023-12-26"),
    ("2023-12-31", "2024-01-01"),
    ("2024-01-14", "2024-01-16"),
    ("2024-01-26", "2024-01-26"),
    ("2024-03-08", "2024-03-08"),
    ("2024-03-25", "2024-03-26"),
]

# Right-closed hour bins (-1,4], (4,7], (7,10], (10,16], (16,19], (19,22], (22,24].
DAYPART_BINS = [
    (4, "Late Night (00-04)"),
    (7, "Early Morning (04-07)"),
    (10, "Morning (07-10)"),
    (16, "Midday (10-16)"),
    (19, "Evening (16-19)"),
    (22, "Night Peak (19-22)"),
    (24, "Late Night (22-24)"),
]

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: duration ---------------------------------------------------
MAX_VALID_DURATION_MIN = 48 * 60  # valid iff 0 < d < 2880

# Left-closed tiers [0,30), [30,120), [120, inf).
DURATION_TIERS = [
    (30.0, "Quick (<30 min)"),
    (120.0, "Moderate (30-120 min)"),
    (float("inf"), "Prolonged (>120 min)"),
]
TIER_LABELS = [label for _, label in DURATION_TIERS]

# --- fixed values: impact index ----------------------------------------------
IMPACT_WEIGHTS = {"closure": 40, "duration": 35, "priority": 15, "corridor": 10}
PRIORITY_FRAC_HIGH, PRIORITY_FRAC_OTHER = 1.0, 0.3
CORRIDOR_FRAC_YES, CORRIDOR_FRAC_NO = 1.0, 0.25

# [lo, hi) score bands with their colours.
BANDS = [
    (0.0, 25.0, "Low", "#34D399"),
    (25.0, 50.0, "Medium", "#F5A623"),
    (50.0, 75.0, "High", "#F2784B"),
    (75.0, 100.0001, "Critical", "#E5484D"),
]

# --- fixed values: resources --------------------------------------------------
BASE_PERSONNEL = {
    "vip_movement": 6, "protest": 8, "public_event": 6, "procession": 5,
    "construction": 2, "accident": 3, "vehicle_breakdown": 1, "pot_holes": 1,
    "tree_fall": 2, "water_logging": 2, "road_conditions": 1, "congestion": 2,
    "debris": 1, "test_demo": 1, "Fog/Low Visibility": 2, "others": 1,
}
DEFAULT_BASE_PERSONNEL = 2
SEVERITY_MULT_BASE, SEVERITY_MULT_SPAN = 0.6, 1.4
CLOSURE_EXTRA_PERSONNEL = 2


# --- fixed values: geometry ---------------------------------------------------
EARTH_RADIUS_KM = 6371.0
METERS_PER_DEGREE_LAT = 111_320.0
BARRICADE_RING_M = 130.0
OFFICER_RING_M = 28.0
ROAD_BARRICADE_M = 90.0
ROAD_OFFICER_RING_M = 24.0
ROAD_SNAP_RADIUS_M = 400.0
DIVERSION_RADIUS_M = 1200.0
CONFLICT_RADIUS_M = 500.0
BBOX_PAD_DEG = 0.06
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]

# --- fixed values: spatial context / precedents -------------------------------
CONTEXT_K = 5
SIMILAR_K = 8
SIMILAR_MAX_KM = 5.0
SIMILAR_MIN_SAME_CAUSE = 3
NEAREST_CORRIDORS_K = 3

# --- fixed values: weather -------------------------------------------------------
RAIN_SENSITIVE = ["water_logging", "vehicle_breakdown", "accident", "pot_holes", "Fog/Low Visibility"]

# inclusive WMO code ranges -> description; anything else "Overcast/cloudy"
WMO_DESCRIPTIONS = [
    (0, 3, "Clear / mostly clear"),
    (10, 19, "Mist / haze"),
    (20, 29, "Recent precipitation"),
    (40, 49, "Fog"),
    (51, 67, "Drizzle or rain"),
    (71, 77, "Snow"),
    (80, 82, "Rain showers"),
    (95, 99, "Thunderstorm"),
]
WMO_OTHER = "Overcast/cloudy"
WTTR_RAIN_WORDS = ["rain", "drizzle", "shower", "thunderstorm"]
WTTR_HEAVY_WORDS = ["heavy", "torrential", "thunderstorm"]
WEATHER_DEFAULT_TEMP = 28.0
WEATHER_MAX_AGE_MIN = 30
RAIN_MM_ANY, RAIN_MM_HEAVY = 0.0, 5.0
RAIN_MULT_STEP = 0.25

# --- fixed values: anomaly -----------------------------------------------------
ANOMALY_MIN_CORRIDOR_N = 5
ANOMALY_MIN_N = 3
ANOMALY_THRESHOLD = 0.15

# --- fixed values: models ------------------------------------------------------
CATEGORICAL_FEATURES = [
    "event_cause", "event_type", "corridor", "police_station", "zone",
    "daypart", "geo_cluster",
]
NUMERIC_FEATURES = [
    "latitude", "longitude", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "month", "is_weekend", "is_festival_window", "is_corridor",
]
DURATION_CATEGORICAL = ["event_cause", "event_type", "corridor", "zone", "daypart", "priority"]
DURATION_NUMERIC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month",
                    "is_weekend", "is_festival_window", "is_corridor"]
TRAIN_FRACTION = 0.8
GEO_CLUSTERS = 50
RANDOM_SEED = 42

# processed-table columns kept from the raw export
KEEP_COLS = [
    "id", "event_type", "latitude", "longitude", "address", "event_cause",
    "requires_road_closure", "start_datetime", "end_datetime", "status",
    "priority", "corridor", "created_date", "police_station",
    "closed_datetime", "resolved_datetime", "zone", "junction",
]
FEEDBACK_EXTRA_COLS = [
    "logged_manpower_used", "forecast_impact_score", "escalated_beyond_forecast",
    "feedback_notes", "feedback_logged_at",
]
