"""Readers and the feedback log on files and rows as they come."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from roadpulse.operators.ranks import Ranks
from roadpulse.operators import ml
from roadpulse.sources import feedback as fb
from roadpulse.sources.briefing import load_requests
from roadpulse.sources.incidents import load_incidents
from roadpulse.streaming import jobs

OUTCOME = dict(event_cause="accident", event_type="unplanned", lat=12.9, lon=77.6, address="a", priority="High", corridor=None,
               police_station="p", start_datetime="2024-01-05T10:00:00Z", actual_end_datetime="2024-01-05T11:00:00Z",
               requires_road_closure=False, manpower_used=3, forecast_impact_score=40.0, escalated_beyond_forecast=False, notes="n")


def _outcomes(spark, *changes):
    return spark.createDataFrame([{**OUTCOME, **c} for c in changes], jobs.OUTCOME_SCHEMA)


def test_csv_quotes_line_breaks_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('zone,id,address,latitude,comment\n'
                    'NULL,1,"Near ""Big"" shop, MG Road",12.9,x\n'
                    'z,2,"two\nlines",NA,x\n'
                    ',3,plain,,x\n')
    rows = {r["id"]: r for r in load_incidents(spark, str(path)).collect()}
    assert rows["1"]["address"] == 'Near "Big" shop, MG Road' and rows["1"]["zone"] is None and rows["1"]["latitude"] == "12.9"
    assert rows["2"]["address"] == "two\nlines" and rows["2"]["zone"] == "z" and rows["2"]["latitude"] is None
    assert rows["3"]["zone"] is None and len(rows) == 3 and "comment" not in rows["1"].asDict()


def test_requests_are_bound_by_name(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("event_type,event_cause,request_id,lon,lat,when_ist\nplanned,protest,r1,77.5,12.9,2024-01-05T10:00:00\n"
                    "unplanned,accident,r2,not a number,12.9,soon\n")
    rows = {r["request_id"]: r for r in load_requests(spark, str(path)).collect()}
    assert rows["r1"]["event_type"] == "planned" and rows["r1"]["event_cause"] == "protest"
    assert (rows["r1"]["lat"], rows["r1"]["lon"], rows["r1"]["when_ist"]) == (12.9, 77.5, dt.datetime(2024, 1, 5, 10))
    assert rows["r1"]["shift_id"] is None and rows["r2"]["lon"] is None and rows["r2"]["when_ist"] is None


def test_log_keeps_every_submission_once(spark, tmp_path):
    path = str(tmp_path / "log")
    outs = _outcomes(spark, {}, {}, {"notes": "other"}, {"notes": None}, {"manpower_used": None}, {"start_datetime": "not-a-date"})
    assert fb.log_outcomes(outs, path).count() == 5
    assert fb.log_outcomes(outs, path).count() == 0
    added = fb.log_outcomes(_outcomes(spark, {"corridor": "c"}), path).collect()
    log = {r["id"]: r for r in fb.load_feedback(spark, path).collect()}
    assert len(log) == 6 and log[added[0]["id"]] == added[0]


def test_stream_drops_no_late_or_malformed_outcome(spark, tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    drops = [[OUTCOME], [{**OUTCOME, "start_datetime": "2024-06-01T00:00:00Z"}],
             [{**OUTCOME, "start_datetime": "2023-01-01T00:00:00Z"}, {**OUTCOME, "start_datetime": "garbage"}, OUTCOME]]
    for i, rows in enumerate(drops):
        (base / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        jobs.start_stream_feedback(spark, str(base), str(tmp_path / "log"), str(tmp_path / "ckpt"), max_files=1).awaitTermination()
    starts = sorted(r["start_datetime"] for r in fb.load_feedback(spark, str(tmp_path / "log")).collect())
    assert starts == sorted(["2023-01-01T00:00:00Z", "2024-01-05T10:00:00Z", "2024-06-01T00:00:00Z", "garbage"])


def test_requests_answered_before_are_left_out(spark, tmp_path):
    sink = str(tmp_path / "sink")
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "request_id string")
    assert sorted(r[0] for r in jobs.unanswered(batch, sink, 0).collect()) == ["a", "b"]
    spark.createDataFrame([("a", 0), ("b", 1)], "request_id string, batch_id int").write.partitionBy("batch_id").parquet(sink)
    # a batch that runs again sees only what earlier batches answered
    assert [r[0] for r in jobs.unanswered(batch, sink, 1).collect()] == ["b"]


def test_ranks_and_split_with_ties_and_nulls(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + (i % 3) * (i % 2)) if i % 7 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, start_ts timestamp").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or dt.datetime(1, 1, 1), r[0]))
    ranks = Ranks(frame, "start_ts", "id")
    assert ranks.n == 500 and [r["id"] for r in ranks.at([0, 17, 399, 499])] == [want[k][0] for k in (0, 17, 399, 499)]
    for frac in (0.0, 0.8, 0.95, 1.0):
        got = {r["id"] for r in ml.time_split(frame, frac).where("split = 'train'").collect()}
        assert got == {r[0] for r in want[:int(500 * frac)]}


def test_no_local_scratch_on_a_cluster(monkeypatch):
    from roadpulse import session

    class Context:
        master = "spark://host:1"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
