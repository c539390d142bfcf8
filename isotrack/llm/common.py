"""Helpers that several operators share: scratch tables, ranks and components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS, SPLIT = "spark.sql.shuffle.partitions", "spark.sql.adaptive.forceOptimizeSkewedJoin"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes a query's shuffle files when it ends: what is written as a table needs them no longer."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def partitions_for(df: DataFrame, rows: int = 100_000) -> Iterator[None]:
    """Inside, shuffles have one partition for every ``rows`` rows of ``df``, but no fewer than there are cores and no
    more than are set, and joins on a hot key are split even if that takes one shuffle more.

    For loops over tables that are far smaller than the input, where starting tasks would take most of the time.
    """
    spark = df.sparkSession
    before = {PARTITIONS: spark.conf.get(PARTITIONS), SPLIT: spark.conf.get(SPLIT)}
    spark.conf.set(PARTITIONS, min(int(before[PARTITIONS]), max(spark.sparkContext.defaultParallelism, -(-df.count() // rows))))
    spark.conf.set(SPLIT, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


_WRITTEN: list[str] = []  # folders that ``stage`` has written, in order


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    This cuts the lineage: what follows survives lost executors without
    repeating what came before.  ``options`` are those of the Parquet writer.
    """
    gc.collect()  # frames that are done with let Spark's cleaner drop what they hold
    path = f"{scratch_dir(df.sparkSession)}/isotrack-{uuid.uuid4().hex}/{name}"
    _WRITTEN.append(path)
    with shuffles_end_with_their_query(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stage`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles() if "/isotrack-" in f}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def only_last_table_stays(spark: SparkSession) -> Iterator[None]:
    """Tables of ``stage`` that are written inside are deleted at the end, all but the last: for steps whose result is written there."""
    before = len(_WRITTEN)
    yield
    for path in _WRITTEN[before:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[before:-1]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def with_prefix(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same group.

    ``bucket`` must rise with ``order``, so that a group, however large, is cut
    into pieces: partial sums per (group, bucket) first, their running total
    second, a window inside one bucket last.  No task holds a whole group.
    ``group`` columns must not be null.
    """
    b, base = f"__{out}_b", f"__{out}_base"
    df = df.withColumn(b, bucket)
    sums = df.groupBy(*group, b).agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, b, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*group, b]).withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(b, base)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over the undirected ``edges``.

    Smallest-label propagation with pointer jumping; each round is a few
    shuffles of the edge list and ends in a table of the shared folder.
    Neighbour labels are reduced before the shuffle, so hubs stay spread out.
    """
    with partitions_for(edges):
        return _components(edges.select(F.col(left).alias("src"), F.col(right).alias("dst")))


def _components(both: DataFrame) -> DataFrame:
    both = both.union(both.select("dst", "src"))
    labels = stage(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).select(F.col("src").alias("id"), "component"), "labels0")
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.src).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        step = step.join(up, "component").select("id", "old", F.least("component", "up").alias("component"))
        step = stage(step, "labels")
        labels = step.select("id", "component")
        if step.where("component <> old").isEmpty():
            return labels
