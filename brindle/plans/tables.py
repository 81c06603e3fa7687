"""The supplied tables, and views that stand in for the tables of a listings database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as availability checks: `error` is a failed check, anything else a sighting of the listing `user_id`."""
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("listing"), "ts", (F.col("event_type") == "error").alias("failed"), "event_type", "value")
