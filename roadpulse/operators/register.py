"""The active-events register and forecast-vs-outcome review."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.scoring import base_personnel_table

REGISTER_COLS = ["id", "cause", "event_type", "lat", "lon", "location_name", "when_ist", "impact_score", "band",
                 "color", "closure_prob", "personnel", "barricades", "corridor", "police_station", "priority",
                 "status", "added_at", "shift_id"]


def forecasts_to_register(forecasts: DataFrame) -> DataFrame:
    """F18 append rows: status 'active', id an md5 of the request id and time
    (stable across replays)."""
    return forecasts.select(
        F.md5(F.concat_ws("|", "request_id", F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))).alias("id"),
        F.col("event_cause").alias("cause"), "event_type", "lat", "lon",
        F.coalesce(F.col("location_name"), F.lit("Unknown")).alias("location_name")
        if "location_name" in forecasts.columns else F.lit("Unknown").alias("location_name"),
        "when_ist", "impact_score", F.col("impact_band").alias("band"), F.col("impact_color").alias("color"),
        F.col("closure_p").alias("closure_prob"), F.col("personnel").cast("int").alias("personnel"),
        F.col("barricade_points").cast("int").alias("barricades"), "corridor", "police_station",
        F.col("priority_used").alias("priority"), F.lit("active").alias("status"),
        F.col("requested_at").alias("added_at"), F.col("shift_id").cast("int").alias("shift_id"),
    )


def add_to_register(register: DataFrame, forecasts: DataFrame) -> DataFrame:
    """append new forecasts to the register."""
    return register.select(*REGISTER_COLS).unionByName(forecasts_to_register(forecasts).select(*REGISTER_COLS))


def resolve_all(register: DataFrame) -> DataFrame:
    """mark every event resolved."""
    return register.withColumn("status", F.lit("resolved"))


def clear(register: DataFrame) -> DataFrame:
    """an empty register with the same schema."""
    return register.where(F.lit(False))


def forecast_vs_outcome(feedback: DataFrame) -> DataFrame:
    """per cause, what outcomes say about the resource constants: mean
    personnel actually used vs the base assumption, escalation rate, mean
    forecast score."""
    base = base_personnel_table(feedback.sparkSession)
    g = feedback.groupBy("event_cause").agg(
        F.count("*").alias("n"),
        F.avg("logged_manpower_used").alias("avg_manpower_used"),
        F.avg(F.col("escalated_beyond_forecast").cast("double")).alias("escalation_rate"),
        F.avg("forecast_impact_score").alias("mean_forecast_score"),
    )
    g = g.join(F.broadcast(base), "event_cause", "left")
    g = g.withColumn("base_personnel", F.coalesce(F.col("base_personnel"), F.lit(2)))
    return g.withColumn("manpower_gap", F.col("avg_manpower_used") - F.col("base_personnel"))
