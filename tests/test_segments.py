"""A search over many segments: the same neighbours as over one, planned segment by segment."""
import random

from roadpulse.operators.spatial_index import PointIndex


def test_the_plan_does_not_hold_every_segment_s_search(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"p{i:03d}", 12.9 + rng.random() * 0.1, 77.5 + rng.random() * 0.1) for i in range(90)]
    frame = lambda some: spark.createDataFrame(some, "id string, latitude double, longitude double")
    whole = PointIndex.build(frame(rows), str(tmp_path / "whole"))
    parts = PointIndex.build(frame(rows[:84]), str(tmp_path / "parts"))
    for a in (84, 87):  # fewer points than neighbours: searched by cells
        parts.add(frame(rows[a:a + 3]))
    asked = spark.createDataFrame([(f"r{i}", 12.9 + rng.random() * 0.1, 77.5 + rng.random() * 0.1) for i in range(30)],
                                  "request_id string, lat double, lon double")
    got = parts.knn(asked, 4, columns=["id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan, plan
    want = whole.knn(asked, 4, columns=["id"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
