"""Where results go: usage as Parquet by site, models as JSON lines and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_usage(usage: DataFrame, path: str) -> None:
    """One folder a site, so that a reader of one home opens only its files."""
    usage.write.mode("overwrite").partitionBy("site").parquet(path)


def model_json(models: DataFrame) -> DataFrame:
    """site, channel and the whole model as one JSON text."""
    return models.select("site", "channel", F.to_json(F.struct(*models.columns), {"ignoreNullFields": "false"}).alias("model"))


def write_models(models: DataFrame, path: str) -> None:
    """One JSON text a line, one line a site."""
    model_json(models).select("model").write.mode("overwrite").text(path)


def read_models(spark: SparkSession, path: str, schema) -> DataFrame:
    """Models that :func:`write_models` wrote; ``schema`` is that of the models."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("m")).select("m.*")
