"""Running sums spread over tasks, and the operators built on them."""
import math
import random

from pyspark.sql import functions as F

from roadpulse.operators import metrics, scoring
from roadpulse.operators.prefix import running_sums


def test_running_sums_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.choice([None, 1.5, 2.5, -3.0]), i, rng.choice([None, 1, 2, 7]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, id int, n int")
    got = running_sums(df, ["g"], [F.col("x").desc_nulls_last(), F.col("id")], {"before": "n"}, {"whole": "n"}).collect()
    assert len(got) == len(rows)
    found = {r["id"]: (r["before"], r["whole"]) for r in got}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        total, run = sum(r[3] or 0 for r in own), 0
        for r in own:
            assert found[r[2]] == (run, total)
            run += r[3] or 0


def test_one_group_is_spread_over_tasks(spark):
    """No window over the group alone: its rows stand in many ranges."""
    df = spark.range(40_000).select(F.lit("all").alias("g"), F.col("id"), F.lit(1).cast("long").alias("n"))
    run = running_sums(df, ["g"], [F.col("id")], {"before": "n"})
    assert run.where(F.col("before") != F.col("id")).count() == 0
    plan = run._jdf.queryExecution().analyzed().toString()
    windows = plan.split("windowspecdefinition(")[1:]
    assert windows and all("_range#" in w.split("specifiedwindowframe")[0] for w in windows)


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, id int, n int")
    assert running_sums(df, ["g"], [F.col("id")], {"before": "n"}, {"whole": "n"}).collect() == []
    assert running_sums(df, [], [F.col("id")], {"before": "n"}).collect() == []


def test_rank_metrics_leave_out_rows_without_score_or_label(spark):
    nan = float("nan")
    rows = [(1, 0.9), (0, 0.1), (0, None), (1, nan), (None, 0.5), (0, nan)]
    got = metrics.rank_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    assert (got.roc_auc, got.pr_auc) == (1.0, 1.0)
    b = metrics.binary_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    assert (b.tp, b.fp, b.tn, b.fn, b.positive_rate) == (1, 0, 1, 0, 0.5)


def test_rank_metrics_take_any_scores(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), rng.choice([-math.inf, math.inf, -7.0, 0.0, -0.0, 3.5, 1e300, rng.gauss(0, 100)])) for _ in range(400)]
    got = metrics.rank_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = sum(sum(s >= t for s in pos) / sum(s >= t for _, s in rows) for t in pos) / len(pos)
    assert abs(got.roc_auc - auc) < 1e-12 and abs(got.pr_auc - ap) < 1e-12


def test_rank_metrics_without_one_class(spark):
    schema = "label int, score double"
    assert metrics.rank_metrics(spark.createDataFrame([(1, 0.5), (1, 0.7)], schema)).first() == (None, 1.0)
    assert metrics.rank_metrics(spark.createDataFrame([(0, 0.5)], schema)).first() == (None, None)
    assert metrics.rank_metrics(spark.createDataFrame([], schema)).first() == (None, None)


def test_percentile_without_history_or_with_one_minute_only(spark):
    req = spark.createDataFrame([("a", 5.0), ("b", None), ("a", 7.0)], "request_id string, x double")
    none = spark.createDataFrame([], "duration_min double, duration_valid boolean")
    assert {r.duration_pct for r in scoring.duration_percentile(req, none, "x").collect()} == {0.5}
    hot = spark.createDataFrame([(5.0 + i / 10_000, True) for i in range(4000)] + [(9.0, False)], none.schema)
    got = sorted((r.request_id, r.x, r.duration_pct) for r in scoring.duration_percentile(req, hot, "x").collect() if r.x)
    assert got == [("a", 5.0, 0.0), ("a", 7.0, 1.0)]
