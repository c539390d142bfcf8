"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder_for(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only in local mode without that setting is it a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that a lost executor costs what came after it only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder_for(df.sparkSession))
    return df.checkpoint()
