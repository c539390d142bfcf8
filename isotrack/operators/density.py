"""Binning points into cells and cells into yearly shares under four weightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tracks import segments


def bin_index(x: Column, low: float, high: float, width: float) -> Column:
    """Number of the bin that holds x; the last bin holds its right edge; null outside."""
    n = int(round((high - low) / width))
    return F.when(x == high, n - 1).when((x >= low) & (x < high), F.floor((x - low) / width)).cast("int")


def with_cell(df: DataFrame, lat: str = "lat", lon: str = "lon", width: float = 5.0, box: tuple = (100.0, 180.0, 0.0, 40.0)) -> DataFrame:
    west, east, south, north = box
    n = int(round((east - west) / width))
    cell = bin_index(F.col(lat), south, north, width) * n + bin_index(F.col(lon), west, east, width)
    return df.withColumn("cell_id", cell).where("cell_id IS NOT NULL")


def normalise(df: DataFrame, year: str, value: str = "mass") -> DataFrame:
    total = df.groupBy(year).agg(F.sum(value).alias("__t"))
    return df.join(total, year).select(year, "cell_id", (F.col(value) / F.col("__t")).alias("share"))


def composition(df: DataFrame, weighting: str = "point", year: str = "season", **cells) -> DataFrame:
    """(year, cell_id, share) of present cells; shares of a year sum to 1.

    ``point``: every point counts 1; ``entity``: every entity counts 1 a year;
    ``occupancy``: every entity counts 1 in each cell that it visits;
    ``length``: path length, by midpoints of pieces of at most 25 km.
    """
    if weighting == "length":
        piece = segments(df).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("dist_km") / 25)).cast("int"))
        piece = piece.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("f", (F.col("k") + 0.5) / F.col("n"))
        piece = piece.withColumns({"mlat": F.col("lat") + F.col("f") * (F.col("lat2") - F.col("lat")), "mlon": F.col("lon") + F.col("f") * (F.col("lon2") - F.col("lon"))})
        mass = with_cell(piece, "mlat", "mlon", **cells).groupBy(year, "cell_id").agg(F.sum(F.col("dist_km") / F.col("n")).alias("mass"))
    elif weighting == "point":
        mass = with_cell(df, **cells).groupBy(year, "cell_id").agg(F.count("*").cast("double").alias("mass"))
    elif weighting == "occupancy":
        mass = with_cell(df, **cells).select(year, "sid", "cell_id").distinct().groupBy(year, "cell_id").agg(F.count("*").cast("double").alias("mass"))
    elif weighting == "entity":
        counts = with_cell(df, **cells).groupBy(year, "sid", "cell_id").agg(F.count("*").alias("n"))
        own = counts.groupBy(year, "sid").agg(F.sum("n").alias("own"))
        mass = counts.join(own, [year, "sid"]).groupBy(year, "cell_id").agg(F.sum(F.col("n") / F.col("own")).alias("mass"))
    else:
        raise ValueError(f"unknown weighting: {weighting}")
    return normalise(mass, year)


def period_means(shares: DataFrame, early: tuple[int, int], late: tuple[int, int], year: str = "season") -> DataFrame:
    """Mean share of each cell over all years of two periods; absent cells of a year count 0."""
    n = shares.select(year).distinct().agg(*[F.sum(F.col(year).between(*p).cast("int")).alias(k) for p, k in ((early, "ne"), (late, "nl"))])
    sums = shares.groupBy("cell_id").agg(*[F.sum(F.when(F.col(year).between(*p), F.col("share")).otherwise(0.0)).alias(k) for p, k in ((early, "se"), (late, "sl"))])
    return sums.join(F.broadcast(n)).select("cell_id", (F.col("se") / F.col("ne")).alias("early"), (F.col("sl") / F.col("nl")).alias("late"))


def spine(dims: list[DataFrame], facts: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """Every combination of small dimension tables, with facts where there are any."""
    full = dims[0]
    for d in dims[1:]:
        full = full.crossJoin(d)
    return full.join(facts, keys, "left").na.fill(fill)
