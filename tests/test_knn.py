"""Grid kNN against brute force, including poles and the antimeridian."""
import math
import random

from roadpulse.operators.knn import knn_join


def _hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    dl = p2 - p1
    dn = math.radians(d) - math.radians(b)
    x = math.sin(dl / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dn / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(x))


def _points(rng, n, prefix):
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            lat, lon = 12.9 + rng.gauss(0, 0.05), 77.6 + rng.gauss(0, 0.05)
        elif kind < 0.45:
            lat, lon = 89.9 - abs(rng.gauss(0, 0.05)), rng.uniform(-180, 180)
        elif kind < 0.6:
            lat, lon = rng.uniform(-5, 5), 179.99 if rng.random() < 0.5 else -179.99
        else:
            lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        out.append((f"{prefix}{i}", lat, lon, "a" if rng.random() < 0.7 else "b"))
    return out


def test_knn_matches_brute_force(spark):
    rng = random.Random(7)
    right = _points(rng, 400, "h")
    left = _points(rng, 40, "q")
    R = spark.createDataFrame(right, "hid string, latitude double, longitude double, grp string")
    L = spark.createDataFrame(left, "request_id string, lat double, lon double, grp string")
    for k, keys, max_km in [(5, (), None), (3, ("grp",), None), (8, (), 500.0)]:
        got = {}
        for r in knn_join(L, R, k, right_id="hid", keys=keys, max_km=max_km).collect():
            got.setdefault(r.request_id, []).append((r.nn_rank, r.hid))
        for q, la, lo, g in left:
            cands = [(round(_hav(la, lo, h[1], h[2]), 9), h[0]) for h in right if not keys or h[3] == g]
            if max_km is not None:
                cands = [c for c in cands if c[0] <= max_km]
            want = [h for _, h in sorted(cands)[:k]]
            have = [h for _, h in sorted(got.get(q, []))]
            assert have == want, (k, keys, q)


def test_knn_in_one_dense_cell(spark):
    """Many points within metres, a third of them at one coordinate."""
    rng = random.Random(8)
    right = [(f"h{i:04d}", 12.9, 77.6) if i % 3 == 0 else (f"h{i:04d}", 12.9 + rng.random() * 2e-4, 77.6 + rng.random() * 2e-4)
             for i in range(900)]
    left = [(f"q{i}", 12.9 + rng.random() * 2e-4, 77.6 + rng.random() * 2e-4) for i in range(60)] + [("q-on", 12.9, 77.6)]
    R = spark.createDataFrame(right, "hid string, latitude double, longitude double")
    L = spark.createDataFrame(left, "request_id string, lat double, lon double")
    got = {}
    for r in knn_join(L, R, 4, right_id="hid").collect():
        got.setdefault(r.request_id, []).append((r.nn_rank, r.hid))
    for q, la, lo in left:
        want = [h for _, h in sorted((round(_hav(la, lo, h[1], h[2]), 9), h[0]) for h in right)[:4]]
        assert [h for _, h in sorted(got[q])] == want
