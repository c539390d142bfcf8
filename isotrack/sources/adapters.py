"""The library's point and track tables from the standard event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENCIES = ("USA", "TOKYO", "CMA")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattered points: sid, event_id, iso_time, season, agency, nature, wind, lat, lon."""
    events = table(spark, sf_dir, "events").withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return events.select(
        F.col("user_id").alias("sid"), "event_id", F.col("ts").alias("iso_time"), F.dayofmonth("ts").alias("season"),
        F.element_at(F.array(*map(F.lit, AGENCIES)), (F.col("event_id") % 3 + 1).cast("int")).alias("agency"),
        F.col("event_type").alias("nature"), F.col("value").alias("wind"),
        ((F.col("event_id") * 7919 + F.col("c")) % 4000 / F.lit(100.0)).alias("lat"),
        (F.lit(100.0) + (F.col("event_id") * 104729 + 31 * F.col("c")) % 8000 / F.lit(100.0)).alias("lon"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth tracks with a turning point each: sid, event_id, iso_time, wind, lat, lon."""
    events = table(spark, sf_dir, "events")
    h = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / F.lit(8.64e10)
    events = events.withColumn("h", h)
    return events.select(
        F.col("user_id").alias("sid"), "event_id", F.col("ts").alias("iso_time"), F.col("value").alias("wind"),
        (F.lit(2.0) + F.lit(1.3) * F.col("h") + F.col("user_id") % 4).alias("lat"),
        (F.lit(130.0) + F.lit(2.0) * F.abs(F.col("h") - 15) + F.col("user_id") % 20).alias("lon"),
    )
