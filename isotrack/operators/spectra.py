"""Wavelet power of short series as sums over frequencies, and sums of logarithms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .inference import ar1

OMEGA0 = 6.0
PERIOD = 4 * math.pi / (OMEGA0 + math.sqrt(2 + OMEGA0**2))  # of a scale, in its units
CHI2_95 = -math.log(0.05)  # the 95 % point of chi-squared with two degrees of freedom, over two


def wavelet_power(series: DataFrame, keys: list[str], order: str, y: str, dj: float = 0.125, s0: float = 2.0) -> DataFrame:
    """(keys, j, t, period, power, ratio, inside): Morlet power of each evenly spaced series, without padding.

    Series are detrended and scaled to variance 1; there are 1 + round(log2(n / s0) / dj) scales, 2^dj apart.  ratio
    is over the 95 % level of red noise with the series' lag-one correlation; inside tells whether the period is
    within the cone that the ends don't reach.  A transform is a sum over frequencies for each one, then one over
    these for each scale and moment.  Null values are left out; series of under 4 values, or of equal ones, have no rows.
    """
    own = Window.partitionBy(*keys)
    rows = series.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    rows = rows.select(*keys, F.col(y).cast("double").alias("__y"), (F.row_number().over(own.orderBy(order)) - 1).alias("t"), F.count("*").over(own).alias("__n")).where("__n >= 4")
    fit = rows.groupBy(*keys).agg(F.regr_slope("__y", "t").alias("__b"), F.regr_intercept("__y", "t").alias("__a"))
    rows = rows.join(fit, keys).withColumn("__r", F.col("__y") - F.col("__a") - F.col("__b") * F.col("t"))
    rows = rows.withColumn("__s", F.stddev_samp("__r").over(own)).where("__s > 1e-12").withColumn("__z", F.col("__r") / F.col("__s"))
    noise = ar1(rows, "t", "__z", keys).select(*keys, F.coalesce("ar1", F.lit(0.0)).alias("__ar"))
    waves = rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.floor(F.col("__n") / 2).cast("int")))).withColumn("__w", F.col("__k") * (2 * math.pi) / F.col("__n"))
    waves = waves.groupBy(*keys, "__n", "__k", "__w").agg(F.sum(F.col("__z") * F.cos(F.col("__w") * F.col("t"))).alias("__ref"), F.sum(-F.col("__z") * F.sin(F.col("__w") * F.col("t"))).alias("__imf"))
    top = F.rint(F.log2(F.col("__n") / s0) / dj).cast("int")
    waves = waves.withColumn("j", F.explode(F.sequence(F.lit(0), top))).withColumn("__sf", s0 * F.pow(F.lit(2.0), F.col("j") * dj))
    daughter = F.sqrt(2 * math.pi * F.col("__sf")) * math.pi**-0.25 * F.exp(-((F.col("__sf") * F.col("__w") - OMEGA0) ** 2) / 2)
    waves = waves.withColumn("__df", daughter / F.col("__n")).withColumn("t", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
    c, s = F.cos(F.col("__w") * F.col("t")), F.sin(F.col("__w") * F.col("t"))
    out = waves.groupBy(*keys, "__n", "j", "__sf", "t").agg(F.sum(F.col("__df") * (F.col("__ref") * c - F.col("__imf") * s)).alias("__af"), F.sum(F.col("__df") * (F.col("__ref") * s + F.col("__imf") * c)).alias("__bf"))
    out = out.join(noise, keys).withColumns({"period": F.col("__sf") * PERIOD, "power": F.col("__af") * F.col("__af") + F.col("__bf") * F.col("__bf")})
    a = F.col("__ar")
    red = (1 - a * a) / (1 - 2 * a * F.cos(2 * math.pi / F.col("period")) + a * a)
    edge = F.greatest(F.least(F.col("t"), F.col("__n") - 1 - F.col("t")).cast("double"), F.lit(1e-5)) * (PERIOD / math.sqrt(2))
    return out.select(*keys, "j", "t", "period", "power", (F.col("power") / (red * CHI2_95)).alias("ratio"), (F.col("period") <= edge + 1e-9).alias("inside"))


def log_sum(df: DataFrame, cell: list[str], month: str, terms: list[str]) -> DataFrame:
    """Anomalies of the logarithm of a product and of its factors, by cell and month of the year.

    Adds total, one ``log_``-column a term, and residual (total less the terms).  Only rows where every term is a positive
    number take part, in means too, so that the parts close.
    """
    rows = df.where(" AND ".join(f"{c} > 0 AND {c} < 'Infinity' AND NOT isnan({c})" for c in terms))
    w = Window.partitionBy(*cell, month)
    rows = rows.withColumns({f"log_{c}": F.log(c) for c in terms}).withColumn("total", sum((F.col(f"log_{c}") for c in terms), F.lit(0.0)))
    rows = rows.withColumns({c: F.col(c) - F.avg(c).over(w) for c in ("total", *[f"log_{c}" for c in terms])})
    return rows.withColumn("residual", F.col("total") - sum((F.col(f"log_{c}") for c in terms), F.lit(0.0)))
