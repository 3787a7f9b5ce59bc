"""The driver's tables as the operators' inputs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: capture, label, score, t in microseconds, seq."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS capture", "event_type AS label", "value / 500 AS score", "unix_micros(CAST(ts AS TIMESTAMP)) AS t", "event_id AS seq")


#: The same for an oracle.
DUCK_EVENTS = "ev AS (SELECT user_id AS capture, event_type AS label, value / 500 AS score, epoch_us(ts) AS t, event_id AS seq FROM events)"
