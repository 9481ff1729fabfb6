"""Training, forecast, stream, briefing and model I/O on one small history."""
import re

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import ml, roads, spatial, weather
from roadpulse.plans import catalog
from roadpulse.plans.forecast import flatten_forecast, forecast
from roadpulse.session import materialize
from roadpulse.sources import briefing
from roadpulse.streaming import jobs

SMALL = {name: dict(p, numTrees=5, maxDepth=5) for name, p in ml.DEFAULT_PARAMS.items()}


@pytest.fixture(scope="module")
def requests(spark, sf_dir):
    some = catalog.requests_df(spark, sf_dir)
    return materialize(some.orderBy(F.col("request_id").startswith("rq-test").desc(), "request_id").limit(40), "test_requests")


@pytest.fixture(scope="module")
def trained(history):
    return ml.train_all(history, SMALL, n_init=2)


@pytest.fixture(scope="module")
def told(spark, sf_dir, history, trained, requests):
    nodes, edges = catalog.road_nodes(spark, sf_dir), catalog.road_edges(spark, sf_dir)
    routes = roads.diversion_routes(requests.select("request_id", "lat", "lon"), nodes, edges)
    rain = weather.weather_asof_join(requests, catalog.weather_df(spark, sf_dir)).withColumns(
        {"is_rain": F.lit(True), "multiplier": F.lit(1.5)})
    return materialize(forecast(requests, history, trained[0], road_diversions=routes, weather=rain), "test_forecast")


def test_metrics_are_complete(history, trained):
    rows = {(r.model, r.metric): r.value for r in trained[1].collect()}
    assert rows["all", "n_total_events"] == history.count() == rows["all", "n_train"] + rows["all", "n_test"]
    assert rows["all", "train_window_end_us"] <= rows["all", "test_window_start_us"]
    assert sum(v for (m, k), v in rows.items() if k.startswith("test_share_")) == pytest.approx(1)
    assert len([k for _, k in rows if k.startswith("tier_confusion_")]) == 9
    assert rows["duration_model", "n_train_valid"] > 0
    assert all(0 <= rows[m, k] <= 1 for m, k in (("priority_model", "accuracy"), ("closure_model", "roc_auc")))
    top = trained[2].collect()
    assert len(top) == 45 and all(r.importance >= 0 for r in top)


def test_forecast_with_everything_attached(told, requests):
    rows = {r.request_id: r for r in told.collect()}
    assert set(rows) == {r.request_id for r in requests.collect()}
    for r in rows.values():
        assert 0 <= r.closure_probability <= 1 and 0 <= r.impact.score <= 100 and r.manpower.personnel >= 1
        assert len(r.similar_incidents) <= 8 and r.diversion.mode in ("road_graph", "historical_fallback")
        assert (r.diversion.note is None) == (r.diversion.mode == "road_graph")
        if r.weather_adjusted_closure is not None:
            assert r.weather_adjusted_closure == pytest.approx(min(1.0, r.closure_probability * 1.5), abs=1e-9)
        assert r.anomaly.anomaly_n is None or not (r.anomaly.is_elevated and r.anomaly.is_suppressed)
        assert r.context.police_station != ""  # contexts come back as they were, not as model inputs
    assert len(rows["rq-test-silkboard"].similar_incidents) >= 1
    far = rows["rq-test-far"]
    assert far.diversion.mode == "historical_fallback" and 1 <= len(far.diversion.suggested_routes) <= 3


def test_briefings(spark, told, tmp_path):
    plan = told.select("request_id", "lat", "lon", F.col("barricades.barricade_points").alias("barricade_points"),
                       F.col("manpower.personnel").alias("personnel"))
    texts = briefing.briefing_text(told, spatial.deployment_points(plan))
    rows = {r.request_id: r.briefing for r in texts.collect()}
    assert len(rows) == told.count()
    for r in told.collect():
        text = rows[r.request_id]
        assert text.startswith(f"Briefing {r.request_id}, ") and "\nRisk\n- Impact " in text and "\nDuration\n" in text
        assert f"- {r.manpower.personnel} officers" in text and ("Road closure in the rain" in text) == (r.weather_adjusted_closure is not None)
        assert len(re.findall(r"(?m)^- B\d+ to the ", text)) == r.barricades.barricade_points
        assert len(re.findall(r"(?m)^- P\d+ ", text)) == r.manpower.personnel and ("\nPrecedents\n" in text) == (len(r.similar_incidents) > 0)
    briefing.write_briefings(texts, str(tmp_path / "out"))
    written = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert all(f"### {k}" in written for k in rows)


def test_models_save_and_load(history, trained, tmp_path):
    ml.save_models(trained[0], str(tmp_path / "m"))
    again = ml.load_models(str(tmp_path / "m"))
    sample = ml.assign_geo_cluster(again["geo_kmeans"], history).limit(50)
    one = [r.closure_p for r in ml.predict_closure(trained[0]["closure_model"], sample).orderBy("id").collect()]
    assert one == [r.closure_p for r in ml.predict_closure(again["closure_model"], sample).orderBy("id").collect()]
    assert ml.predict_closure(again["closure_model"], sample).drop("closure_p").exceptAll(sample).count() == 0


def test_stream_equals_batch(spark, history, trained, requests, tmp_path):
    some = requests.limit(12)
    src = jobs.land_drops(some, str(tmp_path / "in"), F.col("requested_at"), n_drops=2, repeat=0)
    for _ in range(2):
        jobs.start_stream_forecast(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), history, trained[0],
                                   max_files=1).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch_id").distinct().count() >= 2
    got = sorted(tuple(r) for r in out.select("request_id", "impact_score", "personnel", "n_similar").collect())
    batch = flatten_forecast(forecast(some, history, trained[0]))
    assert got == sorted(tuple(r) for r in batch.select("request_id", "impact_score", "personnel", "n_similar").collect())
