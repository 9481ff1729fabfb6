"""Quality classifier by positive-unlabelled learning.

Trusted positives are a bounded sample of documents labelled good; unlabelled
are all documents of the corpus, whatever their label.  The class prior is
estimated from how the two differ under a first classifier (best-bin estimate:
Garg et al., 2021), and the scorer minimises the non-negative unbiased risk
(Kiryo et al., 2017) with logistic loss, whose output is a probability.

Losses, slopes and curvatures of the unlabelled documents are summed up by Spark
over all rows, one pass for each Newton step.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import discard, fold, fresh, table, written
from roadpulse.llm.surface import NAMES, labelled, surface

#: trusted positives fitted on, at most
SAMPLE = 8000
THRESHOLD = 0.7
#: passes of a fit at most, and the gain in risk under which it ends
PASSES, ENOUGH, RIDGE = 30, 1e-7, 1e-4
#: weight of the logarithm that keeps the negative risk from falling below zero
BARRIER = 1e-3


def _design(x: np.ndarray) -> np.ndarray:
    """A constant, and each feature at three scales, so that small rates count."""
    return np.column_stack([np.ones(len(x)), x, np.minimum(1, 8 * x), np.minimum(1, 50 * x)])


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over rows, flat: loss of calling them negative, its slope and curvature,
    the design's sum, and the number of rows."""
    d = _design(x)
    z = d @ w
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.concatenate([[np.logaddexp(0, z).sum()], d.T @ p, ((d.T * (p * (1 - p))) @ d).ravel(), d.sum(0), [len(d)]])


def _means(sums: np.ndarray):
    k = 1 + 3 * len(NAMES)
    sums = sums / sums[-1]
    return sums[0], sums[1:k + 1], sums[k + 1:k + 1 + k * k].reshape(k, k), sums[k + 1 + k * k:-1]


def _newton(risk) -> np.ndarray:
    """Minimum of ``risk``, which gives value, slope and curvature, or nothing
    where it may not go; steps are halved until the value falls."""
    w = np.zeros(1 + 3 * len(NAMES))
    value, slope, curve = risk(w)
    step, left = np.linalg.solve(curve, slope), PASSES - 1
    while left and np.abs(step).max() > 1e-9:
        new, left = risk(w - step), left - 1
        if new is None or new[0] > value:
            step = step / 2
            continue
        w, gain = w - step, value - new[0]
        value, slope, curve = new
        if gain < ENOUGH:
            break
        step = np.linalg.solve(curve, slope)
    return w


def _cuts(good: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(good, np.linspace(0.02, 0.9, 89)))


def _best_bin(good: np.ndarray, cuts: np.ndarray, above_other: np.ndarray, others: int) -> float:
    above_good = np.array([(good >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(good)) + 1 / np.sqrt(others))
    best = ((above_other + slack) / above_good).argmin()
    return float(np.clip(above_other[best] / above_good[best], 0.05, 0.98))


def estimate_prior(good: np.ndarray, other: np.ndarray) -> float:
    """Share of positives among unlabelled rows: the smallest ratio, with its
    sampling error, of the two samples' shares above a score."""
    cuts = _cuts(good)
    return _best_bin(good, cuts, np.array([(other >= c).mean() for c in cuts]), len(other))


def _totals(features: DataFrame, of) -> np.ndarray:
    """Sum over all rows of ``of``, which sums up a batch's features; partitions
    give one row each, and the driver gets one number a place."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for batch in batches:
            if len(batch):
                part = of(np.array(batch["x"].tolist(), float))
                out = part if out is None else out + part
        if out is not None:
            yield pd.DataFrame({"sums": [out.tolist()]})

    rows = features.select("x").mapInPandas(task, "sums array<double>").select(F.posexplode("sums").alias("at", "n"))
    return np.array([r["n"] for r in sorted(rows.groupBy("at").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["at"])])


def fit_nnpu(good: np.ndarray, features: DataFrame) -> tuple[np.ndarray, float]:
    """Weights over ``_design`` and the class prior, from features of trusted
    positives and of all unlabelled rows (columns half, 0 or 1, and x)."""
    ridge = RIDGE * np.eye(1 + 3 * len(NAMES))
    halves = [features.filter(F.col("half") == k) for k in (0, 1)]
    sides = [(good[k::2], halves[k]) for k in (0, 1)]
    if len(good) < 2 or not all(h.head(1) for h in halves):
        sides = [(good, features)] * 2

    def first(p, u):  # tell them apart
        def versus(w):
            down, down_slope, down_curve, _ = _means(_totals(u, lambda x: _sums(x, w)))
            false_p, p_slope, p_curve, p_design = _means(_sums(p, w))
            # the loss of calling z positive is that of calling it negative, less z
            return (down + false_p - p_design @ w + w @ ridge @ w / 2, down_slope + p_slope - p_design + ridge @ w,
                    down_curve + p_curve + ridge)
        return _newton(versus)

    # each half's share of positives, by the classifier that learned from the other half
    found, rows = [], []
    for (p, u), (from_p, from_u) in zip(sides, sides[::-1]):
        w = first(from_p, from_u)
        scores = _design(p) @ w
        cuts = _cuts(scores)
        reached = _totals(u, lambda x: np.append((_design(x) @ w >= cuts[:, None]).sum(1), len(x)).astype(float))
        found.append(_best_bin(scores, cuts, reached[:-1] / reached[-1], int(reached[-1])))
        rows.append(reached[-1])
    prior = float(np.average(found, weights=rows))

    def risk(w):
        down, slope, curve, _ = _means(_totals(features, lambda x: _sums(x, w)))
        false_p, false_slope, _, p_design = _means(_sums(good, w))
        negative, away = down - prior * false_p, slope - prior * false_slope
        if negative <= 0:  # overfitted negatives: not that far
            return None
        # positive and corrected negative loss of the positives leave -z; a barrier keeps the negative risk above zero
        return (down - prior * p_design @ w + w @ ridge @ w / 2 - BARRIER * np.log(negative),
                slope - prior * p_design + ridge @ w - BARRIER / negative * away,
                curve + ridge + BARRIER / negative**2 * np.outer(away, away))

    return _newton(risk), prior


def _features(text):
    @F.pandas_udf("array<double>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([surface(t) for t in texts], dtype=object)
    return made(text)


def train(docs: DataFrame, labels: DataFrame, learnable, text="text", key="doc_id", label="quality", sample=SAMPLE) -> list[float]:
    """Weights of the scorer.  ``learnable`` says which labelled ids may be
    learned from; at most ``sample`` positives and all documents, as
    unlabelled ones, are used.  Without any positive or document: a constant
    that scores every text 0.5."""
    trusted = labelled(docs, labels.filter(F.col(label) == 1), label, learnable, text, key, sample)
    good = trusted.select("id", _features(F.col("text")).alias("x")).orderBy("id").collect()  # ``sample`` rows of a few numbers
    if not good:
        return [0.0] * (1 + 3 * len(NAMES))
    features = written(docs.select(F.pmod(F.xxhash64(F.col(key)), F.lit(2)).alias("half"),
                                   _features(F.col(text).cast("string")).alias("x")), "quality_features")
    weights, _ = fit_nnpu(np.array([r["x"] for r in good], float), features)
    discard(features)
    return weights.tolist()


def score(text, weights: list[float]):
    """Probability, in 0 to 1, that a text column's texts are good."""
    w = np.array(weights)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if not len(texts):
                yield pd.Series([], dtype="float64")
                continue
            z = _design(np.array([surface(t) for t in texts], float)) @ w
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, learnable, text="text", key="doc_id", **options) -> DataFrame:
    """``docs`` with score and predicted (score >= 0.7).  Null and empty texts
    are scored as texts without words; every row gets a score; columns named
    like the added ones are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    weights = train(docs, labels, learnable, text, key, **options)
    return docs.withColumn("score", score(F.col(text), weights)).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


FOLDS, HELD_OUT = 4, 2


def op3_quality(spark, sf_dir):
    """Score every whole text of documents for quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"), fold("doc_id", FOLDS) != HELD_OUT)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier does not reject."""
    kept, = fresh(docs, "quality_kept")
    weights = train(docs, labels, fold("doc_id", FOLDS) != HELD_OUT)
    return docs.withColumn(kept, score(F.col("text"), weights)).filter(F.col(kept) >= THRESHOLD).drop(kept)
