"""Readers of raw point tables, index files and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import wrap_lon


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_points(spark: SparkSession, path: str, columns: dict[str, str], numeric: list[str], time: str = "iso_time", required: list[str] = (), units_row: bool = False) -> DataFrame:
    """A CSV point table: chosen columns (new name -> header), blanks and bad numbers null.

    ``units_row``: the first data row names units and is left out; it is the
    row whose time does not parse though all required text is there.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = require_columns(raw, list(columns.values())).select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
    out = raw.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in numeric}).withColumn(time, F.to_timestamp_ntz(F.when(F.trim(F.col(time)).rlike(r"^\d{4}-\d\d-\d\d"), F.trim(F.col(time)))))
    if units_row:
        out = out.where(F.col(time).isNotNull())
    if "lon" in out.columns:
        out = out.withColumn("lon", wrap_lon(F.col("lon")))
    return out.na.drop(subset=list(required)) if required else out


def read_monthly_index(spark: SparkSession, path: str, months: list[int], name: str) -> DataFrame:
    """A text table of a year and twelve months per line: mean of the chosen months; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where((F.size("p") >= 13) & F.col("p")[0].rlike(r"^\d{4}$"))
    values = F.array(*[F.col("p")[m].try_cast("double") for m in months])
    mean = F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / len(months)
    return lines.select(F.col("p")[0].cast("int").alias("season"), mean.alias(name)).where(F.col(name).isNotNull())


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def missing_years(df: DataFrame, first: int, last: int, year: str = "season") -> DataFrame:
    """Years of the range that the table lacks."""
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(year))
    return spine.join(df.select(year).distinct(), year, "left_anti")
