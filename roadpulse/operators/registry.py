"""Versions of the models, of which forecasts use the champion.

A version is a complete set (clusters and the four forests, which depend on
them), saved in its own folder and then named by the registry's manifest.  A
challenger and the champion score the same rows, later than all that either
learned from; the set that wins is published as champion in one atomic step, so
a forecast or stream sees whole sets only and a failed save changes nothing.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.temporal import duration_tier
from roadpulse.operators import metrics as M
from roadpulse.operators import ml
from roadpulse.session import materialize
from roadpulse.sources.manifest import Manifest, Taken

#: what decides, by model: metric, and 1 if more of it is better, -1 if less
DECISIVE = {"priority_model": ("f1_weighted", 1), "closure_model": ("pr_auc", 1),
            "duration_model": ("mae_minutes", -1), "duration_tier_model": ("f1_macro", 1)}
#: the share of a decisive metric that a challenger may lose, if it gains more elsewhere
TOLERANCE = 0.02


def start_us(column: str = "start_ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def decisive_scores(models: dict, holdout: DataFrame) -> dict[str, float | None]:
    """Each model's decisive metric on prepared, labelled incidents; None where
    the rows say nothing about it (no row, or one class)."""
    rows = ml.assign_geo_cluster(models["geo_kmeans"], holdout)
    valid = rows.where("duration_valid").withColumn("tier", duration_tier("duration_min"))
    priority = ml.predict_priority(models["priority_model"], rows).select("priority", "suggested_priority")
    closure = ml.predict_closure(models["closure_model"], rows).select(
        F.col("requires_road_closure").cast("int").alias("label"), "closure_p")
    duration = ml.predict_duration(models["duration_model"], valid).select("duration_min", "ml_duration_min")
    tier = ml.predict_tier(models["duration_tier_model"], valid).select("tier", "tier_prediction")
    told = {"priority_model": M.multiclass_metrics(materialize(priority, "duel_priority"), "priority", "suggested_priority"),
            "closure_model": M.rank_metrics(materialize(closure, "duel_closure"), "label", "closure_p"),
            "duration_model": M.regression_metrics(materialize(duration, "duel_duration"), "duration_min", "ml_duration_min"),
            "duration_tier_model": M.multiclass_metrics(materialize(tier, "duel_tier"), "tier", "tier_prediction")}
    return {name: told[name].select(metric).first()[0] for name, (metric, _) in DECISIVE.items()}


def gains(champion: dict, challenger: dict) -> dict[str, float]:
    """Relative gain of the challenger by model, for metrics that both have."""
    out = {}
    for name, (_, sign) in DECISIVE.items():
        old, new = champion.get(name), challenger.get(name)
        if old is not None and new is not None:
            out[name] = sign * (new - old) / max(abs(old), 1e-9)
    return out


def wins(champion: dict, challenger: dict, tolerance: float = TOLERANCE) -> bool:
    """More gained than lost in all, and no model worse by more than the
    tolerance.  Rows that say nothing about any model leave the champion."""
    g = gains(champion, challenger)
    return bool(g) and sum(g.values()) > 0 and min(g.values()) >= -tolerance


class ModelRegistry:
    """The model versions of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        self._loaded: tuple[str, dict] | None = None

    def champion(self) -> dict | None:
        """The champion's entry (name, learned_until, scores), None before the first."""
        content = self.manifest.read()[1]
        return content.get("versions", {}).get(content.get("champion"))

    def history(self) -> DataFrame:
        """(name, outcome, model, metric, champion, challenger) of every duel so far."""
        rows = [(d["name"], d["outcome"], model, DECISIVE[model][0], d["champion"].get(model), d["challenger"].get(model))
                for d in self.manifest.read()[1].get("duels", []) for model in DECISIVE]
        return self.spark.createDataFrame(
            rows, "name string, outcome string, model string, metric string, champion double, challenger double")

    def models(self) -> dict:
        """The champion of this moment; loaded again only if it has changed."""
        entry = self.champion()
        if entry is None:
            raise LookupError(f"{self.path}: no models have been published")
        if self._loaded is None or self._loaded[0] != entry["name"]:
            self._loaded = (entry["name"], ml.load_models(self._folder(entry["name"])))
        return self._loaded[1]

    def _folder(self, name: str) -> str:
        return f"{self.path}/models/{name}"

    def challenge(self, models: dict, learned_until: int | None, candidates: DataFrame) -> bool:
        """Save ``models`` as a version and make it champion if it wins on the
        ``candidates`` that start after all that either set has learned from
        (``learned_until``: microseconds; None: nothing is excluded).  The first
        version is champion at once.  If another version is published
        meanwhile, the challenger meets that one."""
        name = uuid.uuid4().hex[:12]
        ml.save_models(models, self._folder(name))
        while True:
            version, content = self.manifest.read()
            old = content.get("versions", {}).get(content.get("champion"))
            entry = {"name": name, "learned_until": learned_until}
            duel, won = None, True
            if old is not None:
                bounds = [b for b in (old["learned_until"], learned_until) if b is not None]
                holdout = candidates.where(start_us() > F.lit(max(bounds))) if bounds else candidates
                # both are judged as they were saved, on the same written rows
                holdout = materialize(holdout, "duel_rows")
                theirs = decisive_scores(ml.load_models(self._folder(old["name"])), holdout)
                ours = decisive_scores(ml.load_models(self._folder(name)), holdout)
                won = wins(theirs, ours)
                duel = {"name": name, "outcome": "won" if won else "lost", "champion": theirs, "challenger": ours}
            new = {"versions": {**content.get("versions", {}), name: entry}, "champion": name if won else old["name"],
                   "duels": content.get("duels", []) + ([duel] if duel else [])}
            try:
                self.manifest.publish(version + 1, new)
                return won
            except Taken:
                continue


def retrain_and_challenge(registry: ModelRegistry, history_raw: DataFrame, feedback: DataFrame, prepare, **kw) -> bool | None:
    """Export and feedback log -> new models -> duel with the champion.
    An empty log trains nothing (None), unless there is no champion yet."""
    from roadpulse.sources.feedback import augment_with_feedback
    if feedback.isEmpty():
        if registry.champion() is not None:
            return None
        raw = history_raw
    else:
        raw = augment_with_feedback(history_raw, feedback)
    models, data = ml.fit_all(prepare(raw), **kw)
    until = data.where(F.col("split") == "train").agg(F.max(start_us())).first()[0]
    try:
        return registry.challenge(models, until, data.where(F.col("split") == "test").drop("geo_cluster", "split"))
    finally:
        data.unpersist()


def current_models(models: dict | ModelRegistry) -> dict:
    """A set of models, or the champion of a registry."""
    return models.models() if isinstance(models, ModelRegistry) else models
