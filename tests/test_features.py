"""One-hot features where an unseen category encodes as all zeros."""
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from roadpulse.operators.ml import feature_stages


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("a", 4.0)], "cat string, x double")
    model = Pipeline(stages=feature_stages(["cat"], ["x"])).fit(train)
    test = spark.createDataFrame([("a", 5.0), ("zzz", 6.0)], "cat string, x double")
    rows = {r.cat: r.features.toArray().tolist() for r in model.transform(test).collect()}
    # three known categories -> three one-hot slots, then the numeric
    assert len(rows["a"]) == 4
    assert rows["a"][:3].count(1.0) == 1 and rows["a"][3] == 5.0
    assert rows["zzz"][:3] == [0.0, 0.0, 0.0] and rows["zzz"][3] == 6.0
