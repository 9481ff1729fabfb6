"""Many requests at once: measured block by block, equal to brute force, few of them by pairs."""
import random

import pytest

from roadpulse.operators import spatial_index
from roadpulse.operators.spatial_index import PointIndex
from tests.test_knn import _points
from tests.test_spatial_index import SCHEMA, found, nearest

ASKED = "request_id string, lat double, lon double, grp string"


def even(rng, n, prefix):
    return [(f"{prefix}{i:04d}", 12.9 + rng.random() * 0.2, 77.5 + rng.random() * 0.2, rng.choice("ab")) for i in range(n)]


@pytest.mark.parametrize("around, k, by, km", [(3, 5, False, None), (256, 8, True, 5.0)])
def test_blocks_equal_brute_force(spark, tmp_path, monkeypatch, around, k, by, km):
    monkeypatch.setattr(spatial_index, "BLOCK", 20)
    monkeypatch.setattr(spatial_index, "SHARE", 7)
    monkeypatch.setattr(spatial_index, "AROUND", around)
    rng = random.Random(17)
    right = _points(rng, 120, "h") + even(rng, 200, "e")
    right += [(f"p{i:03d}", 12.95, 77.55, "b" if i % 5 else "a") for i in range(40)]  # one place, more points than a block holds
    right += [("h-none", None, 1.0, "a"), ("h-key", 12.96, 77.56, None)]
    left = _points(rng, 30, "q") + even(rng, 40, "r") + [("q-on", 12.95, 77.55, "b"), ("q-far", -60.0, -120.0, "a")]
    index = PointIndex.build(spark.createDataFrame(right, SCHEMA), str(tmp_path / "ix"), id="hid", keys=("grp",))
    asked = spark.createDataFrame([*left, ("q-none", None, 5.0, "a"), ("q-key", 12.9, 77.6, None)], ASKED)
    right = [r for r in right if r[1] is not None]
    got = found(index.knn(asked, k, by_keys=by, max_km=km))
    for q, la, lo, g in left:
        assert got.get(q, []) == nearest(right, la, lo, k, g if by else None, km), q
    assert "q-none" not in got and ("q-key" in got) == (not by)


def test_most_requests_are_measured_in_blocks(spark, tmp_path, monkeypatch):
    """Pairs and cells were made for every request."""
    monkeypatch.setattr(spatial_index, "BLOCK", 64)
    rng = random.Random(5)
    index = PointIndex.build(spark.createDataFrame(even(rng, 600, "h"), SCHEMA), str(tmp_path / "ix"), id="hid")
    left, wide = even(rng, 300, "q"), []
    real = spatial_index.materialize
    monkeypatch.setattr(spatial_index, "materialize",
                        lambda df, name: wide.append(df.count()) or real(df, name) if name == "index_met" else real(df, name))
    got = found(index.knn(spark.createDataFrame(left, ASKED), 4))
    assert len(got) == 300 and all(len(v) == 4 for v in got.values())
    assert sum(wide) < 300


def test_repeated_request_ids_are_ranked_together(spark, tmp_path):
    rng = random.Random(6)
    right = even(rng, 50, "h")
    index = PointIndex.build(spark.createDataFrame(right, SCHEMA), str(tmp_path / "ix"), id="hid")
    at = (12.95, 77.6, "a")
    got = found(index.knn(spark.createDataFrame([("q", *at), ("q", *at), ("one", *at)], ASKED), 3))
    best = nearest(right, *at[:2], 3)
    assert got == {"one": best, "q": [best[0], best[0], best[1]]}
