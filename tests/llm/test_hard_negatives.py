"""Hard-negative mining against brute force."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import hard_negatives
from roadpulse.llm.hard_negatives import mine, threshold_pairs
from roadpulse.llm.vectors import LEAST, MOST, products, within

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=100, positives=5, negatives=10, scale=256):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [max(LEAST, min(MOST, math.floor(x * scale) if abs(x * scale) < 1e300 else int(math.copysign(MOST, x)))) for x in v]
        held[i] = min(held.get(i, (label, v)), (label, v))
    score = lambda a, b: max(LEAST, min(MOST, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = sorted((-score(v, w), i) for i, (_, w) in held.items() if i != a)
        for p, positive in [(i, -s) for s, i in scored if held[i][0] == label][:positives]:
            fit = [(i, -s) for s, i in scored if held[i][0] != label and 30 * positive <= -100 * s <= 90 * positive]
            out += [(a, p, rank, i, positive, s) for rank, (i, s) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                  for r in df.collect())


def clusters(n, width, seed, labels=6, noise=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, width))
    of = rng.integers(0, labels, n)
    v = middle[of] + noise * rng.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    wrong = np.where(rng.random(n) < 0.3, rng.integers(0, labels, n), of)
    return [(i, int(wrong[i]), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("negative", [False, True])
def test_threshold_pairs_are_exact(negative):
    rng = np.random.default_rng(3)
    for _ in range(40):
        width = int(rng.integers(1, 40))
        q, x = rng.integers(-50, 50, (7, width)), rng.integers(-50, 50, (60, width))
        x[:20, width // 2:] = 0  # light tails, which the index leaves out
        may = rng.random((7, 60)) < 0.8
        scores = q @ x.T
        t = np.quantile(scores, 0.3 if negative else 0.97, axis=1).astype(np.int64)
        at, row, score = threshold_pairs(q, t, x, may)
        found = {(a, b): s for a, b, s in zip(at.tolist(), row.tolist(), score.tolist())}
        assert found == {(a, b): scores[a, b] for a, b in zip(*np.nonzero(may & (scores >= t[:, None])))}


def test_products_never_wrap():
    a = np.array([[10**18, 10**18], [-(1 << 63), 1], [3, 4]], np.int64)
    exact = [[max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in a] for p in a]
    assert products(a, a).tolist() == exact
    assert within(a, a).tolist() == [exact[i][i] for i in range(3)]


@pytest.mark.parametrize("shape", [(900, 24, 8192, 3, 2), (900, 24, 1 << 20, 256, 4096), (400, 5, 2048, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, shape):
    n, width, size, batch, summaries = shape
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", size)
    monkeypatch.setattr(hard_negatives, "BATCH", batch)
    monkeypatch.setattr(hard_negatives, "SUMMARIES", summaries)
    rows = clusters(n, width, n + width)
    rows += [(n + i, rows[7][1], rows[7][2]) for i in range(60)]  # copies: ties
    rows += [(2 * n + i, (rows[7][1] + 1) % 6, rows[7][2]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(mine(df, every=50)) == brute(rows, every=50)


def test_edges(spark):
    rows = [(0, 1, [1.0, 0.0]), (100, 1, [0.5, None]), (200, None, [1.0, 1.0]), (300, 2, None), (400, 1, [float("nan"), 1.0]),
            (1, 1, [1.0, 0.1]), (2, 1, [0.9]), (3, 2, [0.5, 0.5, 7.0]), (4, 2, [0.6, 0.0]), (4, 2, [0.6, 0.0]), (4, 2, [0.5, 0.0]),
            (None, 1, [1.0, 0.0]), (500, 3, []), (501, 3, []), (5, 4, [0.0, 1.0]), (6, 2, [-1.0, 0.0]),
            (600, 5, [-1.0, 0.0]), (601, 5, [1.0, 0.0]), (700, 7, [1e300, 1e17]), (701, 7, [1e17, -1e300]), (702, 8, [1e16, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("LABEL_", F.lit(1))
    expected = brute(rows)
    assert got(mine(df)) == expected
    assert {r[0] for r in expected} >= {0, 500}
    assert mine(df.limit(0)).collect() == []
    assert mine(df.where("vec_id % 100 > 0")).collect() == []
    only = spark.createDataFrame([(0, 1, []), (1, 1, []), (2, 2, [])], SCHEMA)
    assert got(mine(only)) == brute([(0, 1, []), (1, 1, []), (2, 2, [])])


def test_windows_that_hardly_fill_are_searched_to_their_end(spark, monkeypatch):
    """Negatives lie only near the lower end, in another shard than the anchor."""
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 512)
    rows = [(i, 0, [1.0, 0.01 * i, 0.0]) for i in range(40)] + [(40 + i, 1, [0.31, 0.0, 2.0 + i]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(mine(df)) == brute(rows)
