"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated.

The lexicon is learned: words and word beginnings that stand in toxic training
texts far more often than in clean ones, in three grades.  Features are their
densities, how near they stand to a second person, and the surface rates of
capitals, punctuation and obfuscation.  Trees (MLlib) are fitted, and calibrated
by isotonic regression, on what lexicons and trees of other rows say (``train``).
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import fold, fresh, table, written
from roadpulse.llm.surface import NAMES, labelled, surface

#: labelled documents fitted on, at most
SAMPLE = 9000
THRESHOLD = 0.7
TREES, DEPTH = 20, 4
#: word beginnings that may enter the lexicon, its grades by log odds, and its bound
BEGINNINGS = (3, 4, 5, 6)
GRADES = (math.log(4), math.log(8), math.log(30))
LEXICON = 4000
#: remembered words per worker
MEMO = 300_000

#: second-person words of English, German, French and Spanish (fixed values)
SECOND_PERSON = frozenset(("you your yours yourself ya u ur du dich dir dein deine ihr euch euer vous votre vos tu te ton ta tes toi "
                           "usted ustedes tú ti tuyo vosotros").split())
#: signs read as letters in obfuscated words (fixed values)
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
WORDS = re.compile(r"[^\W\d_]+")
EDGES = ".,;:!?*&$%#|-\"'()[]{}<>"


def token_words(token: str) -> list[str]:
    """Words of a lower-case token; an obfuscated one also as it is meant."""
    inner = token.strip(EDGES)
    if inner.isalpha():
        return [inner]
    words = WORDS.findall(inner)
    meant = "".join(c for c in inner.translate(LOOKALIKES) if c.isalpha())
    return words + [meant] if len(meant) > 2 else words


def grams(word: str) -> list[str]:
    """The word itself, and its beginnings (marked)."""
    return [word] + [word[:k] + "~" for k in BEGINNINGS if len(word) >= k]


def learn_lexicon(train: DataFrame, size=LEXICON) -> dict[str, int]:
    """Grade (1 to 3) of each lexicon entry, from training rows (text, y)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(batch["text"], batch["y"]):
                (toxic if y else clean).update({g for t in set((text or "").lower().split()) for w in token_words(t) for g in grams(w)})
            # an entry needs toxic texts, so the others matter only where it has some
            seen = list(set(toxic) | set(clean))
            yield pd.DataFrame({"gram": seen, "toxic": [toxic[g] for g in seen], "clean": [clean[g] for g in seen]})

    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    least = max(3, math.ceil(0.02 * bad))
    odds = F.log(((F.col("toxic") + 0.0) / bad) / ((F.col("clean") + 0.5) / good))
    top = (
        train.select("text", "y").mapInPandas(count, "gram string, toxic long, clean long")
        .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= least).withColumn("odds", odds).filter(F.col("odds") >= GRADES[0])
        .orderBy(F.col("odds").desc(), "gram").limit(size).collect()
    )
    return {r["gram"]: sum(r["odds"] >= g for g in GRADES) for r in top}


class _Reader:
    """Features of texts under one lexicon."""

    def __init__(self, lexicon: dict[str, int]):
        self.memo: dict[str, int] = {}
        self.whole = {g: x for g, x in lexicon.items() if g[-1] != "~"}
        self.beginnings = {k: {g[:-1]: x for g, x in lexicon.items() if g[-1] == "~" and len(g) == k + 1} for k in BEGINNINGS}
        self.starts = {g[:3] for g in lexicon}

    def grade(self, token: str) -> int:
        """0 to 3, and 4 more if a whole word of the lexicon is meant."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        best = whole = 0
        for w in token_words(token):
            if w[:3] not in self.starts:
                continue
            x = self.whole.get(w, 0)
            whole = max(whole, x)
            best = max(x, best, *[by.get(w[:k], 0) for k, by in self.beginnings.items()])
        self.memo[token] = best = best + 4 if whole >= 2 else best
        return best

    def __call__(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        n = max(1, len(tokens))
        grades = list(map(self.memo.get, tokens))
        if None in grades:
            grades = [self.grade(w) if g is None else g for w, g in zip(tokens, grades)]
        high = [i for i, g in enumerate(grades) if g >= 2]
        by = [grades.count(1), sum(1 for i in high if grades[i] & 3 == 2), sum(1 for i in high if grades[i] & 3 == 3)]
        whole = sum(1 for i in high if grades[i] >= 4)
        near = 0.0
        if high:
            persons = [i for i, w in enumerate(tokens) if w.strip(EDGES) in SECOND_PERSON]
            if persons:
                for i in high:
                    k = bisect_left(persons, i)
                    gap = min(abs(persons[j] - i) for j in (k - 1, k) if 0 <= j < len(persons))
                    near += math.exp(-gap / 10)
                near /= len(high)
        return [*(b / n for b in by), *(math.log1p(b) for b in by), whole / n, math.log1p(whole), near] + surface(text)


FEATURES = 9 + len(NAMES)


def features(text, lexicon: dict[str, int]):
    @F.pandas_udf("array<double>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = _Reader(lexicon)
        for texts in batches:
            yield pd.Series([read(t) for t in texts], dtype=object)
    return made(text)


class ToxicityModel:
    """A lexicon, trees and a calibration; ``scored`` adds a probability."""

    def __init__(self, lexicon, trees, isotonic, constant=0.0):
        self.lexicon, self.trees, self.isotonic, self.constant = lexicon, trees, isotonic, constant

    def scored(self, docs: DataFrame, text: str, column: str) -> DataFrame:
        if self.trees is None:
            return docs.withColumn(column, F.lit(float(self.constant)))
        x, raw, p, label, margin = fresh(docs, "tox_x", "tox_raw", "tox_p", "tox_label", "tox_margin")
        trees = self.trees.copy().setFeaturesCol(x).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(label)
        out = trees.transform(docs.withColumn(x, array_to_vector(features(F.col(text), self.lexicon))))
        out = out.withColumn(margin, vector_to_array(raw)[1])
        if self.isotonic is None:
            out = out.withColumn(column, vector_to_array(p)[1])
        else:
            out = self.isotonic.copy().setFeaturesCol(margin).setPredictionCol(column).transform(out)
        return out.drop(x, raw, p, label, margin).withColumn(column, F.least(F.greatest(column, F.lit(0.0)), F.lit(1.0)))


#: parts of the training rows; what is learned for a part never saw it
PARTS = 3


def train(docs: DataFrame, labels: DataFrame, learnable, text="text", key="doc_id", label="toxic", sample=SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents that ``learnable`` admits.
    With no label, or one class alone, every score is that class's (0 for none).

    The rows are dealt by id into ``PARTS``.  Trees are fitted to features under
    lexicons that were learned from the other parts, as those of new texts are,
    and the calibration to margins of trees that saw neither the row nor a
    lexicon made with it.  Scores come from the lexicon and trees of all rows."""
    rows = written(labelled(docs, labels, label, learnable, text, key, sample).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(PARTS))), "toxic_sample")
    lexicon = learn_lexicon(rows)
    if not lexicon and rows.select("y").distinct().count() < 2:
        one = rows.agg(F.max("y")).first()[0]
        return ToxicityModel({}, None, None, one or 0)
    classes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.countDistinct("y").alias("n")).collect()}
    # too few rows to learn both classes without any of the parts: one lexicon, no calibration
    apart = len(classes) == PARTS and min(classes.values()) == 2
    seen = F.col("y").cast("double").alias("y")
    if apart:
        parts = [rows.filter(F.col("part") == p).select("id", "part", seen, features(
            F.col("text"), learn_lexicon(rows.filter(F.col("part") != p))).alias("a")) for p in range(PARTS)]
        ready = reduce(DataFrame.unionByName, parts)
    else:
        ready = rows.select("id", "part", seen, features(F.col("text"), lexicon).alias("a"))
    ready = written(ready.coalesce(4), "toxic_features").withColumn("x", array_to_vector("a"))
    boosted = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=42,
                            minInstancesPerNode=3)
    isotonic = None
    if apart:
        margins = [boosted.fit(ready.filter(F.col("part") != p)).transform(ready.filter(F.col("part") == p))
                   .select("y", vector_to_array("rawPrediction")[1].alias("margin")) for p in range(PARTS)]
        isotonic = IsotonicRegression(featuresCol="margin", labelCol="y").fit(reduce(DataFrame.unionByName, margins))
    return ToxicityModel(lexicon, boosted.fit(ready), isotonic)


FOLDS, HELD_OUT = 3, 1


def classify(docs: DataFrame, labels: DataFrame, learnable, text="text", key="doc_id", **options) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= 0.7).  Null and
    empty texts are scored as texts without words; columns named like the
    added ones are replaced; ids, sources and languages are no inputs."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    model = train(docs, labels, learnable, text, key, **options)
    return model.scored(docs, text, "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_toxicity(spark, sf_dir):
    """Score every whole text of documents for toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels"), fold("doc_id", FOLDS) != HELD_OUT)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier does not reject as toxic."""
    score, = fresh(docs, "toxic_score")
    model = train(docs, labels, fold("doc_id", FOLDS) != HELD_OUT)
    return model.scored(docs, "text", score).filter(F.col(score) < THRESHOLD).drop(score)
