"""Forests whose branches grow beside their rows."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from roadpulse.operators import ml
from roadpulse.operators.forest import Forest, _codes, _Growth, walk
from roadpulse.plans.forecast import dealt_for_scoring

SETTINGS = dict(numTrees=5, maxDepth=30, minInstancesPerNode=1, maxBins=64, seed=3)


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(4000).select("id", F.concat(F.lit("c"), F.col("id") % 5).alias("c"), ((F.col("id") * 37) % 101).cast("double").alias("a"),
                                 F.when(F.col("id") % 50 != 7, ((F.col("id") * 53) % 211).cast("double")).alias("b"))
    return d.withColumns({"y": ((F.col("a") > 40) & (F.col("c") != "c3")).cast("double"), "weight": F.lit(1.0),
                          "z": F.col("a") + F.coalesce("b", F.lit(500.0))}).repartition(4, "id").sortWithinPartitions("id").persist()


def fitted(rows, forest):
    return Pipeline(stages=ml.feature_stages(["c"], ["a", "b"]) + [forest]).fit(rows)


def test_large_nodes_split_over_blocks_as_branches_do(rows):
    for label, classes, column in (("y", True, "probability"), ("z", False, "prediction")):
        told = []
        for large in (1 << 16, 100):
            m = fitted(rows, Forest(label, "weight", large=large, subset="all", classes=classes, **SETTINGS))
            trees = m.stages[-1].trees()
            assert trees.where("node >= 0").agg(F.countDistinct("tree")).first()[0] == 5
            assert label == "y" or large > 4000 or trees.count() > 5 * 10  # 2,500 rows of a tree, 100 a branch at most
            told.append({r["id"]: r[column] for r in m.transform(rows).collect()})
        assert told[0].keys() == told[1].keys() and len(told[0]) == 4000
        assert all(np.allclose(told[0][k], told[1][k]) for k in told[0])


def test_it_learns_saves_and_loads(rows, tmp_path):
    m = fitted(rows, Forest("y", "weight", large=700, subset="sqrt", classes=True, **{**SETTINGS, "numTrees": 25}))
    assert m.transform(rows).where("prediction <> y").count() < 40
    z = fitted(rows, Forest("z", subset="all", classes=False, **SETTINGS)).transform(rows)
    assert z.agg(F.avg(F.abs(F.col("prediction") - F.col("z")))).first()[0] < 5
    importance = m.stages[-1].featureImportances.toArray()
    assert abs(importance.sum() - 1) < 1e-9 and importance.argmax() == 5  # a
    m.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert again.stages[-1].totalNumNodes == m.stages[-1].totalNumNodes
    a, b = ({r["id"]: r["probability"] for r in x.transform(rows).select("id", "probability").collect()} for x in (m, again))
    assert a == b


def test_few_jobs_however_deep(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("forest", "one deep fit")
    ml.Pipeline(stages=ml.feature_stages(["c"], ["a", "b"]) + [ml._rf_classifier(
        dict(numTrees=20, minInstancesPerNode=1, maxDepth=30), "y")]).fit(rows.withColumn("y", F.col("id") % 2))
    jobs = len(sc.statusTracker().getJobIdsForGroup("forest"))
    sc.setJobGroup("", "")
    assert jobs < 15


def test_a_split_by_hand():
    growth = _Growth(np.array([2, 4]), 2, dict(maxDepth=30, minInstancesPerNode=1, seed=1, subset="all"))
    codes = np.array([[0, 0], [1, 1], [0, 2], [1, 3]], np.uint8)
    v = growth.sums(np.array([0.0, 0, 1, 1]), np.ones(4), np.array([1, 2, 1, 1]))
    feats, starts, cells = growth.choice(np.random.default_rng(0), 1)
    gain, feature, at, left = growth.best(growth.histogram(codes, np.zeros(4, int), v, feats, starts, cells), v.sum(0)[:, None], feats, starts)
    assert (feature[0], at[0]) == (1, 1) and np.isclose(gain[0], 5 - (9 + 4) / 5)
    assert left[:, 0].tolist() == [3, 0, 3, 2]


def test_it_scores_a_stream(spark, rows, tmp_path):
    m = fitted(rows, Forest("y", "weight", subset="sqrt", classes=True, **SETTINGS))
    rows.write.json(f"{tmp_path}/in")
    seen = []
    spark.readStream.schema(rows.schema).json(f"{tmp_path}/in").writeStream.foreachBatch(
        lambda batch, i: seen.append(m.transform(batch).where("prediction = y").count())).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) > 3900


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("alike", [True, False])
def test_sums_of_a_branch_are_those_of_its_rows(classes, alike):
    """Cells counted slot by slot, to the last bit as when every column is added up row by row."""
    rng = np.random.default_rng(7)
    growth = _Growth(np.array([2, 5, 3]), classes, dict(maxDepth=30, minInstancesPerNode=1, seed=1, subset="all"))
    y = rng.integers(0, 3, 500).astype(float) if classes else rng.random(500)
    w = (np.array([0.3, 1.1, 2.7])[y.astype(int)] if classes else np.ones(500)) if alike else rng.random(500)
    drawn, cell = rng.integers(1, 4, 500), rng.integers(0, 6, 500)
    columns, add = growth.counted(y, w, drawn)
    v = growth.sums(y, w, drawn)
    assert len(columns) == (2 if classes else 3) + (not alike)
    assert (add(cell, columns, 6) == np.stack([np.bincount(cell, s, 6) for s in v.T[:-1]])).all()


def test_missing_numbers_stand_above_all_bins():
    x = np.array([[0.0, 1.0], [1.0, 2.5], [np.nan, np.nan], [0.5, 9.0]])
    assert _codes(x, [[0.5], [1.0, 2.0, 3.0]]).tolist() == [[0, 0], [1, 2], [1, 3], [0, 3]]


def test_walk_goes_to_the_leaf_of_every_row():
    rng = np.random.default_rng(9)
    growth = _Growth(np.array([2, 200, 256]), 2, dict(maxDepth=30, minInstancesPerNode=1, seed=1, subset="all"))
    codes = np.column_stack([rng.integers(0, b, 400) for b in growth.bins]).astype(np.uint8)
    y = rng.integers(0, 2, 400).astype(float)
    t = growth.grow(codes, y, np.ones(400), np.ones(400, int), 0, rng)
    feature, bins, left = np.frombuffer(t["feature"], "<i2"), np.frombuffer(t["bin"], "u1"), np.frombuffer(t["left"], "<i4")

    def leaf(row):
        at = 0
        while feature[at] >= 0:
            at = left[at] + int(row[feature[at]] > bins[at])
        return at

    assert walk(feature, bins, left, codes).tolist() == [leaf(row) for row in codes]
    assert len(walk(feature, bins, left, codes[:0])) == 0 and walk(np.array([-1]), bins[:1], left[:1], codes).tolist() == [0] * 400


def test_requests_are_dealt_to_tasks_before_they_are_scored(spark):
    """All of them, by their number: a join may have put them into one partition."""
    asked = spark.range(300).select(F.col("id").alias("request_id")).coalesce(1)
    dealt = dealt_for_scoring(asked)
    assert dealt.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in dealt.collect()) == list(range(300))
