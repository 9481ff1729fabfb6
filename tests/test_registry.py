"""Champion and challenger: duels, atomic swaps, and forecasts that follow them."""
import pytest
from pyspark.sql import functions as F

from roadpulse.operators import cleaning, ml, registry as reg
from roadpulse.plans import catalog
from roadpulse.plans.forecast import flatten_forecast, forecast
from roadpulse.session import materialize
from roadpulse.sources import feedback as fb
from roadpulse.sources.manifest import Manifest, Taken
from roadpulse.streaming import jobs

WEAK = {name: dict(p, numTrees=1, maxDepth=1) for name, p in ml.DEFAULT_PARAMS.items()}
BETTER = {name: dict(p, numTrees=8, maxDepth=7) for name, p in ml.DEFAULT_PARAMS.items()}


@pytest.fixture(scope="module")
def sets(history):
    """(weak, better, learned_until, later rows)"""
    weak, data = ml.fit_all(history, WEAK, n_init=1)
    better, _ = ml.fit_all(history, BETTER, n_init=1)
    until = data.where("split = 'train'").agg(F.max(reg.start_us())).first()[0]
    later = materialize(data.where("split = 'test'").drop("geo_cluster", "split"), "test_later")
    return weak, better, until, later


@pytest.mark.parametrize("change,expected", [
    ({}, False), ({"closure_model": 0.6}, True), ({"closure_model": 0.4}, False), ({"duration_model": 50.0}, True),
    ({"duration_model": 70.0}, False), ({"closure_model": 0.9, "priority_model": 0.7}, False),
    ({"closure_model": 0.6, "priority_model": 0.795}, True), ({"closure_model": None}, False)])
def test_who_wins(change, expected):
    champion = {"priority_model": 0.8, "closure_model": 0.5, "duration_model": 60.0, "duration_tier_model": 0.6}
    assert reg.wins(champion, {**champion, **change}) is expected


def test_nothing_to_judge_by_leaves_the_champion():
    nothing = dict.fromkeys(reg.DECISIVE)
    assert not reg.wins(nothing, nothing) and not reg.wins({}, {})


def test_duels_and_what_forecasts_use(spark, sf_dir, history, sets, tmp_path, monkeypatch):
    weak, better, until, later = sets
    r = reg.ModelRegistry(spark, str(tmp_path / "models"))
    with pytest.raises(LookupError):
        r.models()
    assert r.challenge(weak, until, later)
    first = r.champion()["name"]
    requests = materialize(catalog.requests_df(spark, sf_dir).orderBy("request_id").limit(15), "test_some")

    def scored(models):
        return sorted(tuple(x) for x in flatten_forecast(forecast(requests, history, models)).select(
            "request_id", "closure_probability", "tier_prediction").collect())

    before = scored(r)
    assert before == scored(weak)
    # a save that fails leaves the champion
    with monkeypatch.context() as m:
        m.setattr(ml, "save_models", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            r.challenge(better, until, later)
    assert r.champion()["name"] == first and r.history().count() == 0
    # rows that either has learned from judge nothing
    assert not r.challenge(better, 2 ** 62, later) and r.champion()["name"] == first
    assert all(x["challenger"] is None for x in r.history().where("model <> 'duration_model'").collect() if x["metric"] == "pr_auc")
    assert r.challenge(better, until, later) and r.champion()["name"] != first
    assert scored(r) == scored(better) != before
    assert not r.challenge(weak, until, later)
    assert [x[0] for x in r.history().groupBy("outcome").count().orderBy("outcome").collect()] == ["lost", "won"]
    # the stream scores by the champion too
    src = jobs.land_drops(requests, str(tmp_path / "in"), F.col("requested_at"), n_drops=1, repeat=-1)
    jobs.start_stream_forecast(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), history, r).awaitTermination()
    assert sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select(
        "request_id", "closure_probability", "tier_prediction").collect()) == scored(better)


def test_a_race_is_run_again(spark, sets, tmp_path, monkeypatch):
    weak, better, until, later = sets
    r, real, lost = reg.ModelRegistry(spark, str(tmp_path / "m")), Manifest.publish, []

    def publish(self, version, content):
        if not lost:
            lost.append(version)
            real(self, version, {"versions": {}, "champion": None})  # another writer was first
            raise Taken(str(version))
        return real(self, version, content)

    monkeypatch.setattr(Manifest, "publish", publish)
    assert r.challenge(weak, until, later) and lost == [1] and r.manifest.read()[0] == 2


def test_retraining_meets_the_champion(spark, sf_dir, tmp_path):
    r = reg.ModelRegistry(spark, str(tmp_path / "m"))
    raw = materialize(catalog.raw_incidents(spark, sf_dir), "test_raw")
    log = materialize(fb.outcome_rows(catalog.outcomes_df(spark, sf_dir).limit(40)), "test_log")
    assert reg.retrain_and_challenge(r, raw, log.limit(0), cleaning.prepare_incidents, params=WEAK, n_init=1)
    assert reg.retrain_and_challenge(r, raw, log.limit(0), cleaning.prepare_incidents, params=WEAK, n_init=1) is None
    won = reg.retrain_and_challenge(r, raw, log, cleaning.prepare_incidents, params=BETTER, n_init=1)
    assert won in (True, False) and r.history().count() == len(reg.DECISIVE)


def test_swaps_without_forests(spark, tmp_path, monkeypatch):
    """What the manifest holds after duels, with stand-ins for models and their scores."""
    store = {}
    monkeypatch.setattr(ml, "save_models", lambda models, folder: store.__setitem__(folder, models))
    monkeypatch.setattr(ml, "load_models", lambda folder: store[folder])
    monkeypatch.setattr(reg, "decisive_scores", lambda models, rows: {"closure_model": models["x"]} if rows.count() else {})
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) AS start_ts FROM range(10)")
    r = reg.ModelRegistry(spark, str(tmp_path / "m"))
    assert r.champion() is None and r.challenge({"x": 0.5}, 0, rows) and r.models() == {"x": 0.5}
    assert not r.challenge({"x": 0.4}, 0, rows) and r.models() == {"x": 0.5}
    assert not r.challenge({"x": 0.9}, 2 ** 60, rows) and r.models() == {"x": 0.5}  # no row is late enough
    assert r.challenge({"x": 0.6}, None, rows) and r.models() == {"x": 0.6}
    assert r.manifest.read()[0] == 4 and r.history().where("model = 'closure_model' AND outcome = 'won'").count() == 1
