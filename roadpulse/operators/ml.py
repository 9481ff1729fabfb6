"""MLlib models over the processed table.

* split by time at one looked-up row;
* one-hot features where an unseen category encodes as all zeros;
* four random forests with balanced class weights (``forest``);
* metrics as small aggregations over cached predictions.
"""
from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.constants import (
    CATEGORICAL_FEATURES, DURATION_CATEGORICAL, DURATION_NUMERIC, GEO_CLUSTERS, NUMERIC_FEATURES, RANDOM_SEED,
    TIER_LABELS, TRAIN_FRACTION,
)
from roadpulse.functions.temporal import duration_tier
from roadpulse.operators import metrics as M
from roadpulse.operators.forest import Forest
from roadpulse.operators.ranks import Ranks
from roadpulse.session import materialize

# starts of KMeans, as in the reference
GEO_STARTS = 10

PRIORITY_FEATURES = (CATEGORICAL_FEATURES, NUMERIC_FEATURES)
CLOSURE_FEATURES = (CATEGORICAL_FEATURES + ["priority"], NUMERIC_FEATURES)
DURATION_FEATURES = (DURATION_CATEGORICAL, DURATION_NUMERIC)

# forest settings of the reference; where it sets no depth, 30
DEFAULT_PARAMS = {
    "priority": dict(numTrees=300, minInstancesPerNode=3, maxDepth=30),
    "closure": dict(numTrees=400, minInstancesPerNode=2, maxDepth=30),
    "duration": dict(numTrees=300, minInstancesPerNode=25, maxDepth=8),
    "tier": dict(numTrees=300, minInstancesPerNode=15, maxDepth=8),
}

TREE_TUNING = dict(maxBins=128)

# ------------------------------------------------------------------ E2
def time_split(df: DataFrame, frac: float = TRAIN_FRACTION, ts: str = "start_ts", id_col: str = "id") -> DataFrame:
    """The first ``int(n*frac)`` rows by (start time, id) are 'train',
    the rest 'test'; rows without a time stand last.  The last training row
    is looked up once (``Ranks`` over time and id alone), and every row is
    then compared with it."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    ranks = Ranks(df.select(us.alias("us"), F.col(id_col).alias("id")), "us", "id")
    n_train = int(ranks.n * frac)
    if not n_train:
        return df.withColumn("split", F.lit("test"))
    cut = ranks.at([n_train - 1])[0]
    if cut["us"] is None:
        train = us.isNotNull() | (F.col(id_col) <= F.lit(cut["id"]))
    else:
        train = (us < F.lit(cut["us"])) | ((us == F.lit(cut["us"])) & (F.col(id_col) <= F.lit(cut["id"])))
    return df.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))


# ------------------------------------------------------------------ C2/C3
def fit_geo_clusters(df: DataFrame, k: int = GEO_CLUSTERS, seed: int = RANDOM_SEED, n_init: int = GEO_STARTS) -> KMeansModel:
    """KMeans over raw (lat, lon) degrees: ``n_init`` starts (k-means||), of
    which the one with the lowest cost stays.  The starts are independent:
    their jobs run side by side over the same cached points."""
    pts = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="_geo").transform(
        df.select("latitude", "longitude")).persist(StorageLevel.MEMORY_AND_DISK)
    pts.count()  # cached before the starts meet

    def start(i: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + i, featuresCol="_geo", predictionCol="geo_cluster").fit(pts)

    with ThreadPoolExecutor(max_workers=max(1, n_init)) as pool:
        fits = list(pool.map(inheritable_thread_target(start), range(max(1, n_init))))
    pts.unpersist()
    return min(fits, key=lambda km: km.summary.trainingCost)  # of equal ones the first


def assign_geo_cluster(model: KMeansModel, df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Cluster id for any point, as a category string."""
    base = df.drop("geo_cluster") if "geo_cluster" in df.columns else df
    v = VectorAssembler(inputCols=[lat, lon], outputCol=model.getFeaturesCol(), handleInvalid="keep").transform(base)
    return model.transform(v).drop(model.getFeaturesCol()).withColumn("geo_cluster", F.col("geo_cluster").cast("string"))


# ------------------------------------------------------------------ E1/E3
def feature_stages(cats: list[str], nums: list[str]) -> list:
    """One-hot with unknown -> all zeros (index 'keep' + dropLast drops
    exactly the unknown slot), numerics passed through."""
    idx = [f"{c}__idx" for c in cats]
    ohe = [f"{c}__ohe" for c in cats]
    return [
        StringIndexer(inputCols=cats, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True),
        VectorAssembler(inputCols=ohe + nums, outputCol="features", handleInvalid="keep"),
    ]


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """E3: 'balanced' weights n / (classes * n_class) as a ``weight`` column
    (the class-count table has one row per class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
    w = counts.join(tot, how="cross").select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), label)


def _prepare(df: DataFrame) -> DataFrame:
    """Feature columns in model-ready types."""
    out = df
    if "geo_cluster" in out.columns:
        out = out.withColumn("geo_cluster", F.col("geo_cluster").cast("string"))
    casts = {c: F.col(c).cast("double") for c in NUMERIC_FEATURES if c in out.columns}
    cats = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
            set(CATEGORICAL_FEATURES + DURATION_CATEGORICAL + ["priority"]) if c in out.columns}
    return out.withColumns({**casts, **cats})


# ------------------------------------------------------------------ E4-E7
def _rf_classifier(params: dict, label_col: str, subset: str = "sqrt"):
    return Forest(label_col, "weight", seed=RANDOM_SEED, subset=subset, classes=True, **{**TREE_TUNING, **params})


def train_priority(train: DataFrame, params: dict | None = None) -> PipelineModel:
    """High/Low priority, balanced weights."""
    p = dict(DEFAULT_PARAMS["priority"], **(params or {}))
    cats, nums = PRIORITY_FEATURES
    data = with_class_weights(_prepare(train), "priority")
    return _fit_labelled(data, "priority", cats, nums, _rf_classifier(p, "_y"))


def train_closure(train: DataFrame, params: dict | None = None) -> PipelineModel:
    """E5: P(road closure); label 0/1, balanced weights (global, not per tree)."""
    p = dict(DEFAULT_PARAMS["closure"], **(params or {}))
    cats, nums = CLOSURE_FEATURES
    data = _prepare(train).withColumn("_y", F.col("requires_road_closure").cast("double"))
    data = with_class_weights(data, "_y")
    return Pipeline(stages=feature_stages(cats, nums) + [_rf_classifier(p, "_y")]).fit(data)


def train_duration(train: DataFrame, params: dict | None = None) -> PipelineModel:
    """Regressor on log1p(minutes) over valid rows."""
    p = dict(DEFAULT_PARAMS["duration"], **(params or {}))
    cats, nums = DURATION_FEATURES
    data = _prepare(train.where("duration_valid")).withColumn("_y", F.log1p("duration_min"))
    rf = Forest("_y", seed=RANDOM_SEED, subset="all", classes=False, **{**TREE_TUNING, **p})
    return Pipeline(stages=feature_stages(cats, nums) + [rf]).fit(data)


def train_tier(train: DataFrame, params: dict | None = None) -> PipelineModel:
    """3-tier duration classifier, balanced weights."""
    p = dict(DEFAULT_PARAMS["tier"], **(params or {}))
    cats, nums = DURATION_FEATURES
    data = _prepare(train.where("duration_valid")).withColumn("tier", duration_tier("duration_min"))
    data = with_class_weights(data, "tier")
    return _fit_labelled(data, "tier", cats, nums, _rf_classifier(p, "_y"))


def _fit_labelled(data: DataFrame, label: str, cats, nums, forest) -> PipelineModel:
    """Index the text label on the training rows only (so scoring never
    needs a label column) and keep the labels in a final IndexToString
    stage, which is saved with the model."""
    labeler = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(data)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labeler.labels)
    return Pipeline(stages=feature_stages(cats, nums) + [forest, back]).fit(labeler.transform(data))


def _labels(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def _scored(model: PipelineModel, df: DataFrame, added) -> DataFrame:
    """``df`` as it was, with the columns that ``added(prediction)`` names.
    The model sees prepared copies of its inputs; the originals come back."""
    kept = {f"_kept_{i}": c for i, c in enumerate(df.columns)}
    pred = model.transform(_prepare(df.withColumns({k: F.col(c) for k, c in kept.items()})))
    made = added(pred)
    return pred.select(*[F.col(k).alias(c) for k, c in kept.items() if c not in made],
                       *[v.alias(c) for c, v in made.items()])


def predict_priority(model: PipelineModel, df: DataFrame, out: str = "suggested_priority") -> DataFrame:
    return _scored(model, df, lambda p: {out: F.col("predicted_label")})


def predict_closure(model: PipelineModel, df: DataFrame, out: str = "closure_p") -> DataFrame:
    return _scored(model, df, lambda p: {out: vector_to_array("probability")[1]})


def predict_duration(model: PipelineModel, df: DataFrame, out: str = "ml_duration_min") -> DataFrame:
    return _scored(model, df, lambda p: {out: F.expm1("prediction")})


def predict_tier(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Tier prediction and a label -> probability map (3 decimals)."""
    arr = F.array(*[F.lit(v) for v in _labels(model)])
    probs = F.transform(vector_to_array("probability"), lambda p: F.round(p, 3))
    return _scored(model, df, lambda p: {"tier_prediction": F.col("predicted_label"),
                                         "tier_probabilities": F.map_from_arrays(arr, probs)})


# ------------------------------------------------------------------ E14
def feature_importance(model: PipelineModel, sample: DataFrame, top: int = 15) -> DataFrame:
    """Impurity importances named after the one-hot columns
    (``cause_vehicle_breakdown``) or the numeric column, largest first."""
    forest = [s for s in model.stages if hasattr(s, "featureImportances")][-1]
    assembled = model.transform(_prepare(sample).limit(1))
    attrs = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    names = {}
    for group in attrs.values():
        for a in group:
            names[a["idx"]] = a["name"].replace("__ohe_", "_")
    imp = forest.featureImportances.toArray().tolist()
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    spark = sample.sparkSession
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


# ------------------------------------------------------------------ E15
#: rows of a training partition, and the fewest partitions
PART_ROWS, LEAST_PARTS = 100_000, 8


def _spread(df: DataFrame, key: str = "id") -> DataFrame:
    """Training rows dealt by id, in as many partitions as their number asks
    for: bootstrap samples are drawn per partition, so the fitted forests
    depend on the rows alone and not on cores or files."""
    n = max(LEAST_PARTS, -(-df.count() // PART_ROWS))
    return df.repartition(n, key).sortWithinPartitions(key)


def _side_by_side(steps: list) -> list:
    """Results of independent steps, each of few small jobs, submitted together.
    The threads keep the caller's job group and session."""
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(step)) for step in steps]]


def _metric_rows(model_name: str, one_row: DataFrame) -> DataFrame:
    cols = [c for c in one_row.columns]
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(model_name).alias("model"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in cols])).alias("m")).select("m.*")


def fit_all(history: DataFrame, params: dict | None = None, n_init: int = GEO_STARTS, km: KMeansModel | None = None):
    """C2 + E2 + E4-E7: clusters (``km``: those fitted already), time split
    and the four models.  Returns (models, split data); the split data is
    cached for evaluation."""
    params = params or {}
    km = km or fit_geo_clusters(history, n_init=n_init)
    # written once: the fits and the evaluation then plan against a plain
    # scan instead of re-analysing the cleaning + split lineage every step
    data = _spread(materialize(time_split(assign_geo_cluster(km, history)), "ml_split")).persist()
    train = data.where(F.col("split") == "train")
    # the four forests are independent: submit their jobs concurrently so
    # the jobs of one fit fill cores another leaves idle
    fits = {"priority_model": (train_priority, "priority"), "closure_model": (train_closure, "closure"),
            "duration_model": (train_duration, "duration"), "duration_tier_model": (train_tier, "tier")}
    with ThreadPoolExecutor(max_workers=len(fits)) as pool:
        # inheritable: the threads keep the caller's job group / properties
        futures = {name: pool.submit(inheritable_thread_target(fn), train, params.get(key))
                   for name, (fn, key) in fits.items()}
        models = {"geo_kmeans": km, **{name: f.result() for name, f in futures.items()}}
    return models, data


def evaluate_all(models: dict, data: DataFrame, run_id: str | None = None):
    """E10-E14 on the test split: the long metrics table of a run (with
    n_total, train window end, test window start) and the top-15 feature
    importances of the closure, duration and tier models."""
    run_id = run_id or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    head = data.agg(
        F.count("*").alias("n_total_events"),
        F.max(F.when(F.col("split") == "train", F.unix_micros(F.col("start_ts").cast("timestamp")))).alias("train_window_end_us"),
        F.min(F.when(F.col("split") == "test", F.unix_micros(F.col("start_ts").cast("timestamp")))).alias("test_window_start_us"),
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
    )
    parts = [_metric_rows("all", head)]

    test_v = test.where("duration_valid")
    predictions = {
        "ml_pred_priority": lambda: predict_priority(models["priority_model"], test).select("priority", "suggested_priority"),
        "ml_pred_closure": lambda: predict_closure(models["closure_model"], test).select(
            F.col("requires_road_closure").cast("int").alias("_label"), "closure_p"),
        "ml_pred_duration": lambda: predict_duration(models["duration_model"], test_v).select("duration_min", "ml_duration_min"),
        "ml_pred_tier": lambda: predict_tier(models["duration_tier_model"], test_v).withColumn("tier", duration_tier("duration_min"))
        .select("duration_min", "tier", "tier_prediction"),
    }
    pp, cp, dp, tp = _side_by_side([lambda name=name, made=made: materialize(made(), name) for name, made in predictions.items()])
    parts.append(_metric_rows("priority_model", M.multiclass_metrics(pp, "priority", "suggested_priority")
                              .select("accuracy", "f1_weighted")))
    parts.append(_metric_rows("closure_model", M.rank_metrics(cp, "_label", "closure_p")
                              .join(M.binary_metrics(cp, "_label", "closure_p"), how="cross")))
    reg = M.regression_metrics(dp, "duration_min", "ml_duration_min")
    naive = M.naive_baselines(train.where("duration_valid").withColumn("tier", duration_tier("duration_min")),
                              tp, "duration_min", "tier", TIER_LABELS)
    tm = M.multiclass_metrics(tp, "tier", "tier_prediction").select(
        F.col("accuracy").alias("tier_accuracy"), F.col("f1_macro").alias("tier_f1_macro"))
    # class shares of the test split, tier confusion, and how many rows the duration models learned from
    balance = M.class_balance(pp, "priority").select(
        F.lit("priority_model").alias("model"), F.concat(F.lit("test_share_"), F.col("priority")).alias("metric"),
        F.col("share").cast("double").alias("value"))
    confusion = M.confusion_long(tp, TIER_LABELS, "tier", "tier_prediction").select(
        F.lit("duration_model").alias("model"), F.concat(F.lit("tier_confusion_"), "row", F.lit("_"), "col").alias("metric"),
        F.col("n").cast("double").alias("value"))
    learned = train.where("duration_valid").agg(F.count("*").alias("n_train_valid"))
    parts += [balance, confusion, _metric_rows("duration_model", learned)]
    parts.append(_metric_rows("duration_model", reg.join(naive, how="cross").join(tm, how="cross")))

    # each part is a handful of (model, metric, value) rows: evaluate the
    # parts concurrently and keep the numbers as a small table
    with ThreadPoolExecutor(max_workers=len(parts)) as pool:
        rows = [r for rs in pool.map(inheritable_thread_target(lambda df: df.collect()), parts) for r in rs]
    spark = data.sparkSession
    metrics = spark.createDataFrame([(r.model, r.metric, r.value, run_id) for r in rows],
                                    "model string, metric string, value double, run_id string")
    fi = (feature_importance(models["closure_model"], test, 15).withColumn("model", F.lit("closure_model"))
          .unionByName(feature_importance(models["duration_model"], test_v, 15)
                       .withColumn("model", F.lit("duration_model")))
          .unionByName(feature_importance(models["duration_tier_model"], test_v, 15)
                       .withColumn("model", F.lit("duration_tier_model"))))
    return metrics, fi


def train_all(history: DataFrame, params: dict | None = None, n_init: int = GEO_STARTS, run_id: str | None = None):
    """Clusters -> split -> four models -> long metrics table.
    Returns (models dict, metrics DataFrame, feature-importance DataFrame)."""
    models, data = fit_all(history, params, n_init)
    metrics, fi = evaluate_all(models, data, run_id)
    data.unpersist()
    return models, metrics, fi


# ------------------------------------------------------------------ E16
def metric_deltas(new: DataFrame, old: DataFrame) -> DataFrame:
    """New vs previous value of every metric (previous missing -> 0,
    as the reference shows 'was 0.000')."""
    o = old.select("model", "metric", F.col("value").alias("old_value"))
    j = new.join(o, ["model", "metric"], "left")
    return j.select("model", "metric", F.col("value").alias("new_value"),
                    F.coalesce(F.col("old_value"), F.lit(0.0)).alias("old_value"),
                    (F.col("value") - F.coalesce(F.col("old_value"), F.lit(0.0))).alias("delta"))


def retrain_with_feedback(history_raw: DataFrame, feedback: DataFrame, old_metrics: DataFrame, prepare, **kw):
    """A5 union -> E15; metric deltas against the previous run.  An
    empty log skips the retrain (returns None)."""
    from roadpulse.sources.feedback import augment_with_feedback
    if feedback.isEmpty():
        return None
    hist = prepare(augment_with_feedback(history_raw, feedback))
    models, metrics, fi = train_all(hist, **kw)
    return models, metrics, metric_deltas(metrics, old_metrics)


# ------------------------------------------------------------------ A6/A7
def save_models(models: dict, path: str) -> None:
    """Every pipeline + KMeans under ``path/<name>``."""
    _side_by_side([lambda name=name, m=m: m.write().overwrite().save(f"{path}/{name}") for name, m in models.items()])


def load_models(path: str) -> dict:
    kinds = {"geo_kmeans": KMeansModel, **{name: PipelineModel for name in
                                           ("priority_model", "closure_model", "duration_model", "duration_tier_model")}}
    found = _side_by_side([lambda name=name, kind=kind: kind.load(f"{path}/{name}") for name, kind in kinds.items()])
    return dict(zip(kinds, found))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append a run's metrics (long format, keyed by run_id)."""
    metrics.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All logged metrics, or an empty table when none were written."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.parquet(path)
    return spark.createDataFrame([], "model string, metric string, value double, run_id string")


def latest_run(metrics: DataFrame) -> DataFrame:
    """Rows of the most recent run id."""
    last = metrics.agg(F.max("run_id").alias("run_id"))
    return metrics.join(last, "run_id")
