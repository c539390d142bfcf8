"""Table sinks and manifests of what they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import file_inventory


def as_text(df: DataFrame) -> DataFrame:
    """Every column as a CSV holds it: times in ISO form, arrays and structs as JSON, null as null."""
    def text(name: str, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(f"`{name}`").cast("string")

    return df.select(*[text(n, k).alias(n) for n, k in df.dtypes])


def write_csv(df: DataFrame, path: str, gzip: bool = False, units: dict[str, str] | None = None) -> None:
    """A folder of CSV files with headers, one a task, compressed if ``gzip``; null and empty text are told apart by quotes.

    ``units``: texts by column for a row of units at the top of every file; the table must then have few rows, as it is
    written by one task to keep that row first.
    """
    rows = as_text(df)
    if units is not None:
        head = df.sparkSession.range(1).select(*[F.lit(units.get(c)).cast("string").alias(c) for c in df.columns])
        rows = head.withColumn("__o", F.lit(0)).union(rows.withColumn("__o", F.lit(1))).coalesce(1).sortWithinPartitions("__o").drop("__o")
    writer = rows.write.option("header", True).option("nullValue", "").option("emptyValue", '""')
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] = (), rows_each: int = 0) -> None:
    """A Parquet table, partitioned by ``by``; rows of one part come from many tasks, so a hot part is many files.

    ``rows_each``: most rows of a file, 0 for no limit.
    """
    writer = df.write.option("maxRecordsPerFile", rows_each)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the data files of a folder, named below it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    name = F.element_at(F.split("path", f"\\Q{root}\\E/", 2), -1)
    return file_inventory(spark, path).select(name.alias("name"), "bytes", "sha256").where(~F.col("name").rlike(r"(^|/)[._]"))


def check_manifest(found: DataFrame, frozen: DataFrame) -> DataFrame:
    """(name, state) of every file of either manifest: same, changed, missing or new."""
    both = found.select("name", F.col("sha256").alias("now")).join(frozen.select("name", F.col("sha256").alias("then")), "name", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return both.select("name", state.alias("state"))
