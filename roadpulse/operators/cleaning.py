"""ETL: raw or typed incident rows -> processed, feature-engineered table.

Order as in the reference build: clean -> time -> duration -> corridor ->
drop unusable rows.  Everything is a narrow projection (no shuffle), so
the whole build fuses into one whole-stage-codegen span per scan partition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from roadpulse.functions import temporal as T

TS_COLS = ["start_datetime", "end_datetime", "created_date", "closed_datetime", "resolved_datetime"]


def _closure_flag(col: Column, dtype) -> Column:
    """S3: text TRUE/1/yes -> true; anything else, including NULL -> false."""
    if isinstance(dtype, BooleanType):
        return F.coalesce(col, F.lit(False))
    if isinstance(dtype, StringType):
        return F.coalesce(F.lower(F.trim(col)).isin("true", "1", "yes", "1.0", "t", "y"), F.lit(False))
    return F.coalesce(col.cast("double") != 0, F.lit(False))


def clean_categoricals(df: DataFrame) -> DataFrame:
    """B1: defaults and the casing fix; trim on cause only."""
    cause = F.trim(F.coalesce(F.col("event_cause"), F.lit("others")))
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({
        "event_cause": F.when(cause == "Debris", F.lit("debris")).otherwise(cause),
        "event_type": F.coalesce(F.col("event_type"), F.lit("unplanned")),
        "priority": F.coalesce(F.col("priority"), F.lit("Low")),
        "police_station": F.coalesce(F.col("police_station"), F.lit("Unknown")),
        "zone": F.coalesce(F.col("zone"), F.lit("Unknown")),
        "requires_road_closure": _closure_flag(F.col("requires_road_closure"),
                                               dtypes["requires_road_closure"]),
    })


def ensure_columns(df: DataFrame, names, dtype: str = "string") -> DataFrame:
    """Columns the export may lack become typed NULLs (A1 keeps them absent)."""
    missing = {n: F.lit(None).cast(dtype) for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def typed_coordinates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "latitude": F.col("latitude").try_cast("double"),
        "longitude": F.col("longitude").try_cast("double"),
    })


def parse_timestamps(df: DataFrame) -> DataFrame:
    """B2 on every timestamp column (text is parsed, typed is normalised)."""
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({c: T.as_utc_ntz(c, dtypes[c]) for c in TS_COLS if c in dtypes})


def time_features(df: DataFrame) -> DataFrame:
    """B3-B6 from the UTC start time."""
    df = df.withColumn("start_ts", T.to_local("start_datetime"))
    return df.withColumns(T.calendar_columns("start_ts"))


def duration_features(df: DataFrame) -> DataFrame:
    """Duration in minutes and validity flag."""
    d = T.duration_minutes("start_datetime", "resolved_datetime", "closed_datetime", "end_datetime")
    return df.withColumn("duration_min", d).withColumn("duration_valid", T.duration_valid("duration_min"))


def corridor_features(df: DataFrame) -> DataFrame:
    """NULL corridor -> Non-corridor, 0/1 flag."""
    c = F.coalesce(F.col("corridor"), F.lit("Non-corridor"))
    return df.withColumn("corridor", c).withColumn("is_corridor", (c != "Non-corridor").cast("int"))


def drop_unusable(df: DataFrame) -> DataFrame:
    """Rows need coordinates and a parsed start (month)."""
    return df.dropna(subset=["latitude", "longitude", "month"])


def prepare_incidents(raw: DataFrame) -> DataFrame:
    """Full processed-table build (without geo clusters, see ml.geo_clusters)."""
    df = ensure_columns(raw, ["event_cause", "event_type", "priority", "police_station", "zone",
                              "corridor", "junction", "address", "status", "requires_road_closure",
                              *TS_COLS])
    df = typed_coordinates(df)
    df = clean_categoricals(df)
    df = parse_timestamps(df)
    df = time_features(df)
    df = duration_features(df)
    df = corridor_features(df)
    return drop_unusable(df)
