"""C19 against all pairs, with a crowded cell dealt to several tasks."""
import random

import pytest

from roadpulse.operators import spatial
from tests.test_knn import _hav


@pytest.mark.parametrize("share", [3, 2048])
def test_conflicts_equal_all_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(spatial, "CELL_SHARE", share)
    rng = random.Random(12)
    rows = [(f"e{i:03d}", 12.9 + rng.gauss(0, 0.004), 77.6 + rng.gauss(0, 0.004), i % 5, "active" if i % 7 else "resolved") for i in range(150)]
    rows += [(f"p{i}", 89.999 + rng.random() * 1e-3, rng.uniform(-180, 180), 1, "active") for i in range(20)]
    rows += [(f"m{i}", rng.random() * 0.01, 179.999 if i % 2 else -179.999, 2, "active") for i in range(20)]
    rows += [(f"s{i}", 10.0, 20.0, 3, "active") for i in range(8)] + [("none", None, 20.0, 3, "active")]
    df = spark.createDataFrame(rows, "id string, lat double, lon double, personnel int, status string")
    got = {(r.id_a, r.id_b): (r.distance_m, r.combined_personnel) for r in spatial.detect_conflicts(df).collect()}
    live = [r for r in rows if r[4] == "active" and r[1] is not None]
    want = {}
    for i, p in enumerate(live):
        for q in live[i + 1:]:
            d = _hav(p[1], p[2], q[1], q[2]) * 1000
            if d < 500:
                want[min(p[0], q[0]), max(p[0], q[0])] = (d, p[3] + q[3])
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-3 and got[k][1] == want[k][1] for k in want)
