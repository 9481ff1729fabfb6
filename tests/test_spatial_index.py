"""The stored spatial index: regions, segments, crowds, and what a search reads."""
import random
import threading

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import spatial_index
from roadpulse.operators.spatial_index import PointIndex
from roadpulse.sources.manifest import Manifest, Taken
from tests.test_knn import _hav, _points

SCHEMA = "hid string, latitude double, longitude double, grp string"


def nearest(rows, la, lo, k, grp=None, max_km=None):
    found = sorted((round(_hav(la, lo, r[1], r[2]), 9), r[0]) for r in rows if grp is None or r[3] == grp)
    return [h for d, h in found if max_km is None or d <= max_km][:k]


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.request_id, []).append((r.nn_rank, r.hid))
    return {q: [h for _, h in sorted(v)] for q, v in got.items()}


@pytest.fixture(scope="module")
def world():
    rng = random.Random(21)
    right = _points(rng, 900, "h")
    right += [(f"p{i:03d}", 12.95, 77.55, "b" if i % 5 else "a") for i in range(150)]  # one place, many points
    left = _points(rng, 30, "q") + [("q-on", 12.95, 77.55, "b"), ("q-far", -60.0, -120.0, "a")]
    return right, left


def test_segments_and_pruned_regions_equal_brute_force(spark, world, tmp_path, monkeypatch):
    monkeypatch.setattr(spatial_index, "REGION_POINTS", 25)
    monkeypatch.setattr(spatial_index, "CROWD", 4)
    right, left = world
    index = PointIndex.build(spark.createDataFrame(right[:600], SCHEMA), str(tmp_path / "ix"), id="hid", keys=("grp",))
    index.add(spark.createDataFrame(right[600:], SCHEMA))
    index.add(spark.createDataFrame([("z-null", None, 1.0, "a")], SCHEMA))  # no place: nobody's neighbour
    again = PointIndex(spark, str(tmp_path / "ix"))
    assert len(again.content["segments"]) == 2
    asked = spark.createDataFrame([*left, ("q-null", None, 5.0, "a")], "request_id string, lat double, lon double, grp string")
    for k, by, km in ((5, False, None), (8, True, 500.0)):
        got = found(again.knn(asked, k, by_keys=by, max_km=km))
        for q, la, lo, g in left:
            assert got.get(q, []) == nearest(right, la, lo, k, g if by else None, km), (q, k, by)
        assert "q-null" not in got


def test_a_search_lists_only_the_regions_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spatial_index, "REGION_POINTS", 25)
    rng = random.Random(3)
    rows = [(f"h{i}", rng.uniform(-80, 80), rng.uniform(-180, 180), "a") for i in range(1500)]
    index = PointIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "ix"), id="hid")
    regions = index._regions(index.content["segments"][0]).select("_region").distinct().count()
    some, read = rows[5], []
    real = PointIndex._near
    monkeypatch.setattr(PointIndex, "_near", lambda *a: read.append(real(*a)) or read[-1])
    near = index.knn(spark.createDataFrame([("q", some[1] + 1e-4, some[2])], "request_id string, lat double, lon double"), 1)
    assert found(near) == {"q": [some[0]]}
    assert 0 < len(read[-1]) < regions / 4
    scans = [x for x in near._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "_spot" in x]
    assert len(scans) >= 2 and all("PartitionFilters: [_region" in x for x in scans)


def test_compaction_keeps_every_point(spark, world, tmp_path):
    right, left = world
    index = PointIndex.build(spark.createDataFrame(right[:300], SCHEMA), str(tmp_path / "ix"), id="hid", keys=("grp",))
    for i in range(3):
        index.add(spark.createDataFrame(right[300 + 200 * i:500 + 200 * i], SCHEMA))
    index.add(spark.createDataFrame(right[900:], SCHEMA))
    index.compact(most=2)
    assert len(index.content["segments"]) == 2
    asked = spark.createDataFrame(left, "request_id string, lat double, lon double, grp string")
    got = found(index.knn(asked, 6))
    for q, la, lo, _ in left:
        assert got[q] == nearest(right, la, lo, 6)


def test_empty_index_and_empty_requests(spark, tmp_path):
    index = PointIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "ix"), id="hid", keys=("grp",))
    asked = spark.createDataFrame([("q", 1.0, 2.0, "a")], "request_id string, lat double, lon double, grp string")
    assert index.knn(asked, 3).collect() == [] and index.key_counts().collect() == []
    index.add(spark.createDataFrame([("h", 1.0, 2.0, "a")], SCHEMA))
    assert found(index.knn(asked, 3)) == {"q": ["h"]}
    assert index.knn(asked.limit(0), 3).collect() == []


def test_manifest_versions_are_taken_once(spark, tmp_path):
    folder = str(tmp_path / "m")
    assert Manifest(spark, folder).read() == (0, {})
    Manifest(spark, folder).publish(1, {"n": [0]})
    with pytest.raises(Taken):
        Manifest(spark, folder).publish(1, {"n": ["other"]})
    errors = []

    def add(i):
        try:
            Manifest(spark, folder).change(lambda c: {"n": c["n"] + [i]}, tries=50)
        except Exception as e:  # noqa: BLE001 - told by the main thread
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(1, 7)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert sorted(Manifest(spark, folder).read()[1]["n"]) == list(range(7))
