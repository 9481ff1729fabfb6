"""A stored incident history that forecasts read and outcomes are added to.

Beside the points and cells of the spatial index, each segment keeps partial
aggregates that can be added up: closures by cause and corridor, the sums that
corridor centroids are made of, and durations by minute and value.  A forecast
reads these and the regions of its own requests, never the history; adding
outcomes writes one small segment and reads nothing that is there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.spatial_index import PointIndex

KEYS = ("event_cause",)


class LivingHistory(PointIndex):
    """The index of prepared incidents (``cleaning.prepare_incidents``), by cause."""

    @classmethod
    def create(cls, history: DataFrame, path: str) -> "LivingHistory":
        return cls.build(history, path, keys=KEYS)

    def refresh(self) -> "LivingHistory":
        """What has been published since this was opened."""
        self.version, self.content = self.manifest.read()
        return self

    def append(self, incidents: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Add prepared incidents.  A batch that ``stream`` has added already is left out."""
        self.refresh()
        if stream is not None and self.content.get("streams", {}).get(stream, -1) >= batch:
            return
        types = self.spark.createDataFrame([], self.schema).schema
        rows = incidents.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types.fields])
        mark = {"streams": {**self.content.get("streams", {}), stream: batch}} if stream is not None else {}
        self.add(rows, **mark)
        self.compact()

    def _extras(self, df: DataFrame, folder: str) -> None:
        closed = F.col("requires_road_closure").cast("int")
        df.groupBy("event_cause", "corridor").agg(F.count("*").alias("n"), F.count(closed).alias("labelled"), F.sum(closed).alias("closed"))\
            .write.parquet(f"{folder}/rates")
        df.where(F.col("corridor") != "Non-corridor").groupBy("corridor").agg(
            F.count("latitude").alias("n"), F.sum("latitude").alias("lat"), F.sum("longitude").alias("lon"))\
            .write.parquet(f"{folder}/corridors")
        durations = df.where(F.col("duration_valid")).groupBy(
            F.floor("duration_min").cast("int").alias("bucket"), F.col("duration_min").alias("value")).agg(F.count("*").alias("n"))
        durations.repartitionByRange("bucket", "value").sortWithinPartitions("bucket", "value").write.parquet(f"{folder}/durations")
        durations.groupBy("bucket").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/minutes")

    def _parts(self, table: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for s in self.content["segments"]:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s['name']}/{table}"))
        return out

    def rates(self) -> DataFrame:
        """(event_cause, corridor, n, labelled, closed) over all segments."""
        return self._parts("rates", "event_cause string, corridor string, n long, labelled long, closed long").groupBy(
            "event_cause", "corridor").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "closed")])

    def corridor_centroids(self) -> DataFrame:
        """C8 from the sums of all segments."""
        return self._parts("corridors", "corridor string, n long, lat double, lon double").groupBy("corridor").agg(
            (F.sum("lat") / F.sum("n")).alias("latitude"), (F.sum("lon") / F.sum("n")).alias("longitude"))

    def minutes(self) -> DataFrame:
        """(bucket, n): valid durations by whole minute."""
        return self._parts("minutes", "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    def durations(self, buckets: list[int]) -> DataFrame:
        """(bucket, value, n): the valid durations of some minutes."""
        return self._parts("durations", "bucket int, value double, n long").where(F.col("bucket").isin(buckets)).groupBy(
            "bucket", "value").agg(F.sum("n").alias("n"))
