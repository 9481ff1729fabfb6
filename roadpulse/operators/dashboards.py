"""Aggregations over the processed history.

All are single-pass ``groupBy`` aggregations with map-side partial
aggregation; results are tiny (<= causes, corridors, hours).  Top-k reports
use ``orderBy(...).limit(k)``, which Spark plans as TakeOrderedAndProject
(per-partition top-k, then a k-row merge).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.constants import BBOX_PAD_DEG, DAY_NAMES
from roadpulse.functions.scoring import round_half_away
from roadpulse.functions.text import prettify
from roadpulse.operators.quantiles import exact_quantiles


def history_kpis(processed: DataFrame) -> DataFrame:
    """Events, closure %, planned %, median valid duration."""
    head = processed.agg(
        F.count("*").alias("events"),
        (F.avg(F.col("requires_road_closure").cast("double")) * 100).alias("closure_pct"),
        (F.avg((F.col("event_type") == "planned").cast("double")) * 100).alias("planned_pct"),
    )
    med = exact_quantiles(processed.where("duration_valid"), "duration_min", {"median_duration_min": 0.5})
    return head.join(med, how="cross")


def hourly_risk(processed: DataFrame, dow: int) -> DataFrame:
    """Incidents per hour on weekday ``dow`` over the hours seen in the
    history, zero-filled; when that weekday never occurs, the mean over the
    weekdays present."""
    counts = processed.groupBy("dow", "hour").agg(F.count("id").alias("n"))
    per_hour = counts.groupBy("hour").agg(
        F.sum(F.when(F.col("dow") == dow, F.col("n")).otherwise(0)).alias("day_n"),
        F.sum("n").alias("all_n"),
        F.collect_set("dow").alias("days"),
    )
    w = Window.partitionBy()  # <= 24 rows
    days = F.array_distinct(F.flatten(F.collect_list("days").over(w)))
    return per_hour.select(
        F.col("hour").cast("int").alias("hour"),
        F.when(F.array_contains(days, dow), F.col("day_n").cast("double"))
         .otherwise(F.col("all_n") / F.size(days)).alias("incidents"),
    )


def dow_hour_heatmap(processed: DataFrame) -> DataFrame:
    """D3: weekday x hour pivot of counts, zero-filled, all 24 hours; a
    weekday absent from the history is a row of NULLs."""
    spark = processed.sparkSession
    piv = (processed.groupBy("dow_name").pivot("hour", list(range(24))).agg(F.count("id")))
    piv = piv.select("dow_name", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in range(24)])
    days = spark.createDataFrame([(i, d) for i, d in enumerate(DAY_NAMES)], "day_order int, dow_name string")
    return F.broadcast(days).join(piv, "dow_name", "left").orderBy("day_order")


def cause_counts(processed: DataFrame) -> DataFrame:
    """Incidents per cause, most frequent first."""
    return processed.groupBy("event_cause").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_cause")


def top_risk_corridors(processed: DataFrame, min_events: int = 20, top: int = 10) -> DataFrame:
    """Named corridors with >= 20 events, 10 highest closure rates (%)."""
    g = (processed.where(F.col("corridor") != "Non-corridor")
         .groupBy("corridor")
         .agg(F.avg(F.col("requires_road_closure").cast("double")).alias("rate"),
              F.count("*").alias("n_events"))
         .where(F.col("n_events") >= min_events)
         .orderBy(F.desc("rate"), "corridor").limit(top))
    return g.select("corridor", round_half_away(F.col("rate") * 100, 1).alias("closure_rate"), "n_events")


def known_hotspots(processed: DataFrame, top: int = 14) -> DataFrame:
    """Most frequent junctions with their mean position."""
    g = (processed.where(F.col("junction").isNotNull())
         .groupBy("junction")
         .agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count("*").alias("n"))
         .orderBy(F.desc("n"), "junction").limit(top))
    return g.select(prettify("junction").alias("hotspot"), "junction", "lat", "lon", "n")


def map_sample(processed: DataFrame, n: int = 4000) -> DataFrame:
    """Deterministic sample of at most n incidents (smallest md5(id))."""
    return (processed.orderBy(F.md5("id"), "id").limit(n)
            .select("id", "latitude", "longitude", "event_cause", "corridor", "priority",
                    "requires_road_closure"))


def register_kpis(register: DataFrame) -> DataFrame:
    """Register totals (personnel, barricades, critical over active)."""
    active = F.col("status") == "active"
    return register.agg(
        F.count(F.when(active, 1)).alias("active_events"),
        F.count(F.when(~active, 1)).alias("resolved_events"),
        F.coalesce(F.sum(F.when(active, F.col("personnel"))), F.lit(0)).cast("long").alias("total_personnel"),
        F.coalesce(F.sum(F.when(active, F.col("barricades"))), F.lit(0)).cast("long").alias("total_barricades"),
        F.count(F.when(active & (F.col("band") == "Critical"), 1)).alias("critical_active"),
    )


def priority_corridor_determinism(processed: DataFrame) -> DataFrame:
    """Share of rows whose priority equals the corridor rule, with the
    2x2 crosstab counts."""
    rule = F.when(F.col("is_corridor") == 1, F.lit("High")).otherwise(F.lit("Low"))
    return processed.agg(
        F.count("*").alias("n"),
        F.sum((F.col("priority") == rule).cast("int")).alias("n_match"),
        F.avg((F.col("priority") == rule).cast("double")).alias("share_match"),
        F.count(F.when((F.col("is_corridor") == 1) & (F.col("priority") == "High"), 1)).alias("corridor_high"),
        F.count(F.when((F.col("is_corridor") == 1) & (F.col("priority") != "High"), 1)).alias("corridor_other"),
        F.count(F.when((F.col("is_corridor") == 0) & (F.col("priority") == "High"), 1)).alias("noncorridor_high"),
        F.count(F.when((F.col("is_corridor") == 0) & (F.col("priority") != "High"), 1)).alias("noncorridor_other"),
    )


def closure_rate_by_cause(processed: DataFrame) -> DataFrame:
    """Base closure rate per cause."""
    return processed.groupBy("event_cause").agg(
        F.count("*").alias("n"),
        F.avg(F.col("requires_road_closure").cast("double")).alias("closure_rate"))


def missingness_profile(df: DataFrame) -> DataFrame:
    """NULL fraction of every column, one aggregation pass, unpivoted."""
    total = F.count(F.lit(1))
    wide = df.agg(*[(F.lit(1.0) - F.count(F.col(c)) / total).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "null_fraction")


def bbox(processed: DataFrame, pad: float = BBOX_PAD_DEG) -> DataFrame:
    """Padded bounding box (west, north, east, south)."""
    return processed.agg(
        (F.min("longitude") - pad).alias("west"), (F.max("latitude") + pad).alias("north"),
        (F.max("longitude") + pad).alias("east"), (F.min("latitude") - pad).alias("south"))
