"""Operations on gridded fields held as long tables (time, level, lat, lon, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_area_km2


def coarsen(df: DataFrame, factor: int, values: list[str], keys: list[str]) -> DataFrame:
    """Means over factor x factor cells of the grid indices iy and ix."""
    return df.groupBy(*keys, F.floor(F.col("iy") / factor).alias("iy"), F.floor(F.col("ix") / factor).alias("ix")).agg(*[F.avg(v).alias(v) for v in values])


def weighted_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Area-weighted mean by the cosine of latitude."""
    w = F.when(F.col(value).isNotNull(), F.cos(F.radians("lat")))
    return df.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"))


def above_contour(df: DataFrame, keys: list[str], value: str, level: float, base: float, dlat: float, dlon: float) -> DataFrame:
    """Area and intensity above a contour, and its westernmost longitude."""
    area = cell_area_km2(F.col("lat"), dlat, dlon)
    up = F.col(value) >= level
    return df.groupBy(*keys).agg(F.sum(F.when(up, area).otherwise(0.0)).alias("area_km2"), (F.sum(F.when(up, (F.col(value) - base) * area).otherwise(0.0)) / 1e6).alias("intensity"), F.min(F.when(up, F.col("lon"))).alias("west_lon"))


def ridge_latitude(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over longitudes of the southernmost latitude where the value turns from negative, interpolated."""
    w = Window.partitionBy(*keys, "lon").orderBy("lat")
    up = df.withColumns({"v2": F.lead(value).over(w), "lat2": F.lead("lat").over(w)}).where((F.col(value) < 0) & (F.col("v2") >= 0))
    first = up.withColumn("r", F.row_number().over(w)).where("r = 1")
    at = F.col("lat") + (F.col("lat2") - F.col("lat")) * (-F.col(value)) / (F.col("v2") - F.col(value))
    return first.groupBy(*keys).agg(F.avg(at).alias("ridge_lat"), F.count("*").alias("n_lons"))


def layer_mean(df: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Trapezoid mean of the value over its levels; null for a single level."""
    w = Window.partitionBy(*keys).orderBy(level)
    d = df.withColumns({"v2": F.lead(value).over(w), "p2": F.lead(level).over(w)})
    return d.groupBy(*keys).agg(F.try_divide(F.sum((F.col(value) + F.col("v2")) / 2 * (F.col("p2") - F.col(level))), F.max(level) - F.min(level)).alias("layer_mean"))


def composite_difference(df: DataFrame, cell: list[str], value: str, label: str, a: str, b: str) -> DataFrame:
    return df.groupBy(*cell).agg((F.avg(F.when(F.col(label) == a, F.col(value))) - F.avg(F.when(F.col(label) == b, F.col(value)))).alias("difference"))


def axis_of_maximum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean latitude of the largest positive value along each longitude, and the easternmost longitude whose mean is positive."""
    w = Window.partitionBy(*keys, "lon").orderBy(F.desc(value), "lat")
    axis = df.where(F.col(value) > 0).withColumn("place", F.row_number().over(w)).where("place = 1").groupBy(*keys).agg(F.avg("lat").alias("axis_lat"))
    east = df.groupBy(*keys, "lon").agg(F.avg(value).alias("m")).where("m > 0").groupBy(*keys).agg(F.max("lon").alias("east_lon"))
    return axis.join(east, keys, "left")


def deviation(df: DataFrame, cell: list[str], value: str, late: Column) -> DataFrame:
    """Standard deviation over years of each cell, and the late minus early mean in units of it."""
    per = df.groupBy(*cell).agg(F.stddev_pop(value).alias("sd"), (F.avg(F.when(late, F.col(value))) - F.avg(F.when(~late, F.col(value)))).alias("delta"))
    return per.withColumn("ratio", F.try_divide("delta", "sd"))


def bilinear(points: DataFrame, grid: DataFrame, lon0: float, lat0: float, res: float, value: str) -> DataFrame:
    """Points with the value between the four grid nodes (row, col, value) around them; null outside the grid."""
    x, y = (F.col("lon") - lon0) / res, (F.col("lat") - lat0) / res
    at = points.withColumns({"col0": F.floor(x).cast("int"), "row0": F.floor(y).cast("int")}).withColumns({"fx": x - F.floor(x), "fy": y - F.floor(y)})
    for dr in (0, 1):
        for dc in (0, 1):
            node = grid.select((F.col("row") - dr).alias("row0"), (F.col("col") - dc).alias("col0"), F.col(value).alias(f"v{dr}{dc}"))
            at = at.join(node, ["row0", "col0"], "left")
    low, high = (F.col(f"v{r}0") * (1 - F.col("fx")) + F.col(f"v{r}1") * F.col("fx") for r in (0, 1))
    return at.withColumn("interpolated", low * (1 - F.col("fy")) + high * F.col("fy")).drop("col0", "row0", "fx", "fy", "v00", "v01", "v10", "v11")
