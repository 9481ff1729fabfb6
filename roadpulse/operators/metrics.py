"""Evaluation metrics as aggregations (no global sort, no collect).

Rank metrics (ROC-AUC, average precision) need cumulative counts over the
score order.  Rows are first counted by distinct score, so a score held by
many rows costs one row, and the counts are summed along the scores by
``running_sums``, which spreads any set of scores over many tasks.

Rows whose label or score is NULL, or whose score is NaN, are no evidence
either way: the rank and threshold metrics leave them out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.operators.prefix import running_sums
from roadpulse.operators.quantiles import exact_quantiles


def _scored(df: DataFrame, label: str, score: str) -> DataFrame:
    """(label 0/1, score) of the rows that have both."""
    rows = df.select(F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    return rows.where(F.col("_y").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))


def rank_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E8 + E9: exact ROC-AUC (ties count half) and average precision as the
    step sum of recall increments times precision (not trapezoidal).  Scores
    may be any numbers.  Without a positive, or for the AUC a negative, NULL."""
    counts = _scored(df, label, score).groupBy("_s").agg(
        F.sum("_y").alias("_pos"), F.sum(F.lit(1) - F.col("_y")).alias("_neg"))
    run = running_sums(counts, [], [F.col("_s")], {"_pos_below": "_pos", "_neg_below": "_neg"},
                       {"_P": "_pos", "_N": "_neg"}, name="rank_metrics")
    tp, fp = F.col("_P") - F.col("_pos_below"), F.col("_N") - F.col("_neg_below")  # at this score or above
    agg = run.agg(
        F.max("_P").alias("_P"), F.max("_N").alias("_N"),
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0)).alias("_auc_num"),
        F.sum(F.when(F.col("_pos") > 0, F.col("_pos") * tp / (tp + fp))).alias("_ap_num"),
    )
    ok = (F.col("_P") > 0) & (F.col("_N") > 0)
    return agg.select(
        F.when(ok, F.col("_auc_num") / (F.col("_P") * F.col("_N"))).alias("roc_auc"),
        F.when(F.col("_P") > 0, F.col("_ap_num") / F.col("_P")).alias("pr_auc"),
    )


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Precision / recall / F1 at ``score >= threshold`` (0 on zero
    division), positive rate and the confusion counts [[tn, fp], [fn, tp]],
    over the rows that have a label and a score."""
    y, p = F.col("_y") == 1, F.col("_s") >= threshold
    c = _scored(df, label, score).agg(
        F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(~y & ~p, 1)).alias("tn"), F.count(F.when(y & ~p, 1)).alias("fn"),
        F.avg(F.col("_y").cast("double")).alias("positive_rate"),
    )
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    c = c.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return c.withColumn("f1", f1)


def multiclass_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy, weighted F1, macro F1 from the (label, prediction)
    count table (classes = labels and predictions seen)."""
    cm = df.groupBy(F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count("*").alias("_c"))
    support = cm.groupBy(F.col("_l").alias("_k")).agg(F.sum("_c").alias("_sup"))
    predicted = cm.groupBy(F.col("_p").alias("_k")).agg(F.sum("_c").alias("_npred"))
    correct = cm.where(F.col("_l") == F.col("_p")).select(F.col("_l").alias("_k"), F.col("_c").alias("_tp"))
    per = (support.join(predicted, "_k", "full").join(correct, "_k", "left")
           .fillna(0, ["_sup", "_npred", "_tp"]))
    prec = F.when(F.col("_npred") > 0, F.col("_tp") / F.col("_npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("_sup") > 0, F.col("_tp") / F.col("_sup")).otherwise(F.lit(0.0))
    per = per.withColumns({"_prec": prec, "_rec": rec})
    per = per.withColumn("_f1", F.when(F.col("_prec") + F.col("_rec") > 0,
                                       2 * F.col("_prec") * F.col("_rec") / (F.col("_prec") + F.col("_rec")))
                         .otherwise(F.lit(0.0)))
    return per.agg(
        (F.sum("_tp") / F.sum("_sup")).alias("accuracy"),
        (F.sum(F.col("_f1") * F.col("_sup")) / F.sum("_sup")).alias("f1_weighted"),
        F.avg("_f1").alias("f1_macro"),
    )


def confusion_long(df: DataFrame, labels: list[str], label: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion counts for every (actual, predicted) pair of
    ``labels`` (zeros included), with positions for matrix order."""
    spark = df.sparkSession
    lab = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string")
    grid = lab.select(F.col("i").alias("row"), F.col("v").alias("actual")).crossJoin(
        lab.select(F.col("i").alias("col"), F.col("v").alias("predicted")))  # len(labels)^2 constant rows
    counts = df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))
    return (F.broadcast(grid).join(counts, ["actual", "predicted"], "left")
            .select("row", "col", "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Share of each class."""
    return (df.groupBy(label).agg(F.count("*").alias("n"))
            .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))


def regression_metrics(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """MAE and median absolute error in minutes, R^2 in log1p space,
    median actual."""
    d = df.select(F.col(actual).cast("double").alias("_a"), F.col(pred).cast("double").alias("_p"))
    d = d.withColumns({"_ae": F.abs(F.col("_a") - F.col("_p")), "_la": F.log1p("_a"), "_lp": F.log1p("_p")})
    base = d.agg(F.avg("_ae").alias("mae_minutes"), F.avg("_la").alias("_mla"), F.count("*").alias("n"))
    ss = d.join(base.select("_mla"), how="cross").agg(  # 1-row side
        F.sum(F.pow(F.col("_la") - F.col("_lp"), 2)).alias("_ssr"),
        F.sum(F.pow(F.col("_la") - F.col("_mla"), 2)).alias("_sst"))
    med_ae = exact_quantiles(d, "_ae", {"median_ae_minutes": 0.5})
    med_a = exact_quantiles(d, "_a", {"median_actual_minutes": 0.5})
    out = base.join(ss, how="cross").join(med_ae, how="cross").join(med_a, how="cross")
    return out.select("mae_minutes", "median_ae_minutes",
                      (F.lit(1.0) - F.col("_ssr") / F.col("_sst")).alias("r2_log_space"),
                      "median_actual_minutes", "n")


def naive_baselines(train: DataFrame, test: DataFrame, actual: str = "actual", tier: str = "tier",
                    tier_order: list[str] | None = None) -> DataFrame:
    """MAE of predicting the train median, accuracy of predicting the
    train's most frequent tier (ties -> first in ``tier_order``)."""
    med = exact_quantiles(train, actual, {"_train_median": 0.5})
    mae = test.join(med, how="cross").agg(F.avg(F.abs(F.col(actual) - F.col("_train_median")))
                                          .alias("naive_baseline_mae_minutes"))
    order = tier_order or []
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col(tier)) if order else F.lit(0)
    counts = train.where(F.col(tier).isNotNull()).groupBy(tier).agg(F.count("*").alias("_n"))
    mode = (counts.withColumn("_ord", rank)
            .withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_n"), "_ord", tier)))  # <= #tiers rows
            .where(F.col("_r") == 1).select(F.col(tier).alias("_mode")))
    acc = test.join(mode, how="cross").agg(F.avg((F.col(tier) == F.col("_mode")).cast("double"))
                                           .alias("tier_naive_baseline_accuracy"))
    return mae.join(acc, how="cross")
