"""Score a whole table of requests against the history.

One DataFrame DAG for all requests: grid kNN context and precedents
(shuffled equi-joins), model scoring on executors through ``transform``,
small constant tables broadcast, and one result row per request with the
nested forecast schema.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.constants import RAIN_SENSITIVE
from roadpulse.functions import scoring as S
from roadpulse.functions.temporal import calendar_columns
from roadpulse.operators import ml, scoring, spatial
from roadpulse.operators.living_history import LivingHistory
from roadpulse.operators.registry import ModelRegistry, current_models
from roadpulse.session import materialize

def assemble_features(requests: DataFrame, history: DataFrame, models: dict,
                      ctx: DataFrame | None = None) -> DataFrame:
    """F16: request rows with context (C6), geo cluster (C3) and calendar
    features of the local request time (B3-B6; naive times are IST)."""
    ctx = ctx if ctx is not None else spatial.nearest_context(requests, history)
    r = requests.join(ctx, "request_id", "left")
    cal = calendar_columns("when_ist")
    r = r.withColumns({k: v for k, v in cal.items()
                       if k in ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month", "is_weekend",
                                "is_festival_window", "daypart")})
    r = r.withColumns({"latitude": F.col("lat"), "longitude": F.col("lon"),
                       "is_corridor": F.coalesce(F.col("is_corridor"), F.lit(0))})
    return ml.assign_geo_cluster(models["geo_kmeans"], r)


#: rows that a task scores, at most
SCORED_ROWS = 50_000


def dealt_for_scoring(feats: DataFrame) -> DataFrame:
    """Requests dealt to tasks by their number. Scoring costs far more than their
    bytes tell, by which joins would put all of them into a few tasks."""
    n = max(2 * feats.sparkSession.sparkContext.defaultParallelism, -(-feats.count() // SCORED_ROWS))
    return feats.repartition(n, "request_id")


def diversion_fallback(requests_ctx: DataFrame, history: DataFrame) -> DataFrame:
    """C16 fallback: the 3 nearest other corridors as single-name routes."""
    near = spatial.nearest_corridors(requests_ctx.select("request_id", "lat", "lon", "corridor"), history,
                                     exclude_col="corridor")
    return near.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("route_rank", "corridor", "latitude", "longitude"))).alias("_r"))\
        .select("request_id",
                F.transform("_r", lambda x: F.array(x["corridor"])).alias("suggested_routes"),
                F.transform("_r", lambda x: F.struct(x["corridor"].alias("corridor"), x["latitude"].alias("lat"),
                                                     x["longitude"].alias("lon"))).alias("route_points"))


def forecast(requests: DataFrame, history: DataFrame | LivingHistory, models: dict | ModelRegistry, road_diversions: DataFrame | None = None,
             weather: DataFrame | None = None) -> DataFrame:
    """end-to-end forecast for every request (see SURVEY 1.4).

    ``history`` is a table of prepared incidents, or a stored
    ``LivingHistory``, of which only its aggregates and the regions of the
    requests are read.  ``models`` is a set, or a registry, of which the
    champion is used.

    ``road_diversions`` (request_id, approach_count, suggested_routes) comes
    from the road-graph operator when a graph is available; requests it
    does not cover use the historical corridor fallback.  ``weather``
    (request_id, is_rain, multiplier) applies the rain adjustment (F13).  The
    anomaly (F11) compares the adjusted probability with history.
    """
    models = current_models(models)
    # context and precedents come from one index: the history's own, or one written here
    index = spatial.history_index(history)
    # context feeds the features and the corridor fallback: computed once
    ctx = materialize(spatial.nearest_context(requests, index), "forecast_context")
    feats = dealt_for_scoring(materialize(assemble_features(requests, history, models, ctx), "forecast_features"))
    feats = ml.predict_priority(models["priority_model"], feats)
    feats = feats.withColumn("priority_used", S.resolve_priority("priority_override", "suggested_priority"))
    scored = ml.predict_closure(models["closure_model"], feats.withColumn("priority", F.col("priority_used")))
    scored = ml.predict_duration(models["duration_model"], scored)
    scored = ml.predict_tier(models["duration_tier_model"], scored)

    # used twice (stats and the precedent list): written once
    sim = materialize(spatial.similar_incidents(requests, index), "forecast_similar")
    stats = scoring.precedent_stats(requests, sim)
    scored = scored.join(stats, "request_id", "left")
    scored = scored.withColumn("_dur_for_index", F.coalesce("precedent_median_min", "ml_duration_min"))
    if weather is not None:
        scored = scored.join(weather.select("request_id", "is_rain", "multiplier"), "request_id", "left")
        rain_hit = F.coalesce(F.col("is_rain"), F.lit(False)) & F.col("event_cause").isin(*RAIN_SENSITIVE)
        adjusted = F.when(rain_hit, F.least(F.lit(1.0), F.round("closure_p", 3) * F.col("multiplier")))
    else:
        adjusted = F.lit(None).cast("double")
    # read by the percentile, the anomaly and the result: models and precedents run once
    scored = materialize(scored.withColumn("weather_adjusted_closure", adjusted), "forecast_scored")
    anomaly = scoring.closure_anomaly(scored.select(
        "request_id", "event_cause", "corridor", F.coalesce("weather_adjusted_closure", "closure_p").alias("closure_p")), history)
    scored = scored.join(anomaly, "request_id", "left")
    scored = scoring.duration_percentile(scored, history, "_dur_for_index")
    scored = scored.withColumns(S.impact_columns("closure_p", "duration_pct", "priority_used", "is_corridor"))

    fallback = diversion_fallback(requests.select("request_id", "lat", "lon").join(
        ctx.select("request_id", "corridor"), "request_id", "left"), history)
    if road_diversions is not None:
        div = (fallback.join(road_diversions.select("request_id", "approach_count",
                                                    F.col("suggested_routes").alias("_road_routes")),
                             "request_id", "full"))
    else:
        div = fallback.withColumns({"approach_count": F.lit(None).cast("int"),
                                    "_road_routes": F.lit(None).cast("array<array<string>>")})
    scored = scored.join(div, "request_id", "left")
    scored = scoring.recommend_manpower(scored)
    scored = scoring.recommend_barricades(scored, approach_count="approach_count")

    sims = sim.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(
        "nn_rank", "event_cause", "address", "corridor", "priority", "requires_road_closure", "duration_min",
        "duration_valid", "start_ts", "distance_km"))).alias("_sims"))
    scored = scored.join(sims, "request_id", "left")

    road = F.col("approach_count").isNotNull()
    return scored.select(
        "request_id", "event_cause", "event_type", "lat", "lon", "when_ist",
        F.struct("corridor", "police_station", "zone", F.col("is_corridor").cast("int").alias("is_corridor"),
                 "nearest_distance_km", "n_neighbors_used").alias("context"),
        F.struct(F.col("suggested_priority").alias("suggested"), F.col("priority_used").alias("used")).alias("priority"),
        F.round("closure_p", 3).alias("closure_probability"),
        "weather_adjusted_closure",
        F.struct("anomaly_n", "hist_rate", "excess", "percentile", "is_elevated", "is_suppressed").alias("anomaly"),
        F.struct(S.round_half_away(F.col("ml_duration_min"), 1).alias("ml_point_estimate_min"),
                 "tier_prediction", "tier_probabilities", "precedent_median_min", "n_precedents",
                 "p10_min", "p50_min", "p90_min").alias("duration"),
        F.struct(F.col("impact_score").alias("score"), F.col("impact_band").alias("band"),
                 F.col("impact_color").alias("color"),
                 F.struct(F.col("component_closure").alias("closure"), F.col("component_duration").alias("duration"),
                          F.col("component_priority").alias("priority"),
                          F.col("component_corridor").alias("corridor")).alias("components"),
                 "duration_percentile").alias("impact"),
        F.struct("personnel", "base_personnel", "severity_multiplier", "extra_for_closure_management")
         .alias("manpower"),
        F.struct("barricade_points", F.col("barricade_note").alias("note")).alias("barricades"),
        F.struct(F.when(road, F.lit("road_graph")).otherwise(F.lit("historical_fallback")).alias("mode"),
                 "approach_count",
                 F.when(road, F.coalesce(F.col("_road_routes"), F.array().cast("array<array<string>>")))
                  .otherwise(F.col("suggested_routes")).alias("suggested_routes"),
                 F.when(road, F.lit(None)).otherwise(F.col("route_points")).alias("route_points"),
                 F.when(road, F.lit(None).cast("string"))
                  .otherwise(F.lit("No road graph covers this point - showing nearest historical corridors instead."))
                  .alias("note")).alias("diversion"),
        F.coalesce(F.col("_sims"), F.array()).alias("similar_incidents"),
    )


def flatten_forecast(fc: DataFrame) -> DataFrame:
    """Flat view of the forecast (one column per leaf) for reports/checks."""
    return fc.select(
        "request_id", "event_cause", "lat", "lon",
        F.col("context.corridor").alias("corridor"), F.col("context.is_corridor").alias("is_corridor"),
        F.col("priority.used").alias("priority_used"), "closure_probability",
        F.col("duration.tier_prediction").alias("tier_prediction"),
        F.col("duration.n_precedents").alias("n_precedents"),
        F.col("impact.score").alias("impact_score"), F.col("impact.band").alias("impact_band"),
        F.col("manpower.personnel").alias("personnel"),
        F.col("barricades.barricade_points").alias("barricade_points"),
        F.col("diversion.mode").alias("diversion_mode"),
        F.size("similar_incidents").alias("n_similar"),
    )
