"""Versions of the forest model: a retraining job publishes them, runs and streams take the current one.

A version is its tables plus one row in ``published``, written last; a version without that row does not exist, so readers never
see half a model. The current version is the row published last. A stream notes which version a micro-batch takes before it
uses it, and a replayed micro-batch takes the noted one again, whatever has been published since.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.anomaly import Model, load_model, retrain_due, save_model, train, training_window

PUBLISHED = T.StructType([T.StructField("number", T.LongType()), T.StructField("version", T.StringType()), T.StructField("trained_at", T.TimestampType())])


@dataclass
class ModelRegistry:
    folder: str

    def _read(self, spark: SparkSession, path: str, schema: T.StructType) -> list:
        try:
            return spark.read.schema(schema).parquet(path).collect()  # a row a version
        except AnalysisException:  # nothing there yet
            return []

    def current(self, spark: SparkSession):
        """The row of the current version, or None."""
        return max(self._read(spark, f"{self.folder}/published", PUBLISHED), key=lambda r: r.number, default=None)

    def publish(self, model: Model, trained_at: datetime) -> str:
        """Store a model and make it current."""
        spark = model.nodes.sparkSession
        now = self.current(spark)
        number = 1 if now is None else now.number + 1
        version = f"{number:08d}"
        save_model(model, self.folder, version)
        # one file under a name of its own; overwriting makes a repeated attempt at this number harmless
        spark.createDataFrame([(number, version, trained_at)], PUBLISHED).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/published/at={number}")
        return version

    def load(self, spark: SparkSession, version: str | None = None) -> Model | None:
        if version is None:
            row = self.current(spark)
            version = None if row is None else row.version
        return None if version is None else load_model(spark, self.folder, version)

    def for_batch(self, spark: SparkSession, notes: str, epoch: int) -> Model | None:
        """The model of a micro-batch; ``notes`` is a folder of the stream's own."""
        noted = self._read(spark, f"{notes}/epoch={epoch}", T.StructType([T.StructField("version", T.StringType())]))
        if not noted:
            row = self.current(spark)
            spark.createDataFrame([(None if row is None else row.version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{notes}/epoch={epoch}")
            return None if row is None else self.load(spark, row.version)
        return None if noted[0].version is None else self.load(spark, noted[0].version)


def retrain(registry: ModelRegistry, events: DataFrame, now: datetime, hours: int = 24, days: int = 30, **settings) -> str | None:
    """Train on the last ``days`` and publish if the current model is ``hours`` old or there is none; the new version, or None
    when it is not due or there are too few events."""
    spark, at = events.sparkSession, F.lit(now).cast("timestamp")
    row = registry.current(spark)
    last = F.lit(None if row is None else row.trained_at).cast("timestamp")
    if not spark.range(1).select(retrain_due(last, at, hours).alias("due")).first().due:
        return None
    model = train(training_window(events, at, days), **settings)
    return None if model is None else registry.publish(model, now)
