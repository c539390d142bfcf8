"""Trends of yearly series: slopes with intervals from order statistics, and a rank test corrected for autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import Z95, normal_two_sided
from .inference import bh_fdr, sen_bootstrap

LEAST_YEARS = 5


def numbered(series: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, t, v, i, n): finite points of each series in the order of x, numbered from 1."""
    t, v = F.col(x).cast("double"), F.col(y).cast("double")
    rows = series.select(*keys, t.alias("t"), v.alias("v")).where("t IS NOT NULL AND v IS NOT NULL AND NOT isnan(t) AND NOT isnan(v) AND abs(v) < 'Infinity'")
    return rows.withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy("t", "v")), "n": F.count("*").over(Window.partitionBy(*keys))})


def both_ways(rows: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """Pairs of an earlier and a later point of one series, whose columns end in 1 and 2."""
    side = lambda k: rows.select(*keys, *[F.col(c).alias(f"{c}{k}") for c in ("i", *cols)])
    return side(1).join(side(2), keys).where("i1 < i2")


def trend_summary(series: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, mean, slope, low, high, mk_s, z, p, trend) of every series.

    The slope is the median over all pairs of years, its 95 % interval two of the ordered slopes, at ranks that
    come from the normal variance of Kendall's sum with ties taken off.  p is that of the sum, whose variance is
    multiplied by what significant autocorrelations of the ranks of the detrended series add to it; for this the
    years count as consecutive, and detrended values that agree to nine decimals are ties.  A series of under
    five points, or of equal values, has n and mean only; z and p are null, and there is no trend, where the corrected variance is not positive.
    A series is one number a year, so all pairs of its points are few; series are spread over tasks.
    """
    rows = numbered(series, keys, x, y)
    same = lambda c: F.count("*").over(Window.partitionBy(*keys, c))
    tied = lambda k: (F.col(k) - 1) * (2 * F.col(k) + 5)
    base = rows.withColumns({"kv": same("v"), "kt": same("t")}).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.sum(tied("kv")).alias("tie_v"), F.sum(tied("kt")).alias("tie_t"), (F.min("v") < F.max("v")).alias("varies"),
    )
    rise = F.col("v2") - F.col("v1")
    pairs = both_ways(rows, keys, "t", "v").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("t2") > F.col("t1"), rise / (F.col("t2") - F.col("t1"))))).alias("slopes"),
        F.percentile(rise / (F.col("i2") - F.col("i1")), F.lit(0.5)).alias("step"), F.sum(F.signum(rise)).alias("mk_s"),
    )
    flat = rows.join(pairs.select(*keys, "step"), keys).withColumn("d", F.round(F.col("v") - F.col("i") * F.col("step"), 9))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy("d")) + (same("d") - 1) / 2
    ranks = flat.withColumn("dev", rank - (F.col("n") + 1) / 2)
    spread = ranks.groupBy(*keys).agg(F.sum(F.col("dev") * F.col("dev")).alias("spread"))
    lags = both_ways(ranks, keys, "dev", "n").groupBy(*keys, (F.col("i2") - F.col("i1")).alias("lag_years")).agg(F.sum(F.col("dev1") * F.col("dev2")).alias("c"), F.first("n1").alias("n")).join(spread, keys)
    n, k = F.col("n").cast("double"), F.col("lag_years")
    r = F.try_divide("c", "spread")
    extra = lags.groupBy(*keys).agg(F.sum(F.when(F.abs(r) > Z95 / F.sqrt(n), (n - k) * (n - k - 1) * (n - k - 2) * r).otherwise(0.0)).alias("extra"))

    out = base.join(pairs, keys, "left").join(extra, keys, "left")
    whole = n * (n - 1) * (2 * n + 5)
    sigma, count = F.sqrt((whole - F.col("tie_v") - F.col("tie_t")) / 18), F.size("slopes")
    upper, lower = F.least(F.rint((count + Z95 * sigma) / 2), count - 1), F.greatest(F.rint((count - Z95 * sigma) / 2) - 1, F.lit(0.0))
    variance = (whole - F.col("tie_v")) / 18 * (1 + 2 / (n * (n - 1) * (n - 2)) * F.col("extra"))
    fits = (F.col("n") >= LEAST_YEARS) & F.col("varies")
    only = lambda c: F.when(fits, c)
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    out = out.withColumns({
        "slope": only(middle(F.col("slopes"))), "low": only(F.get("slopes", lower.cast("int"))), "high": only(F.get("slopes", upper.cast("int"))),
        "z": only(F.when(variance > 0, (F.col("mk_s") - F.signum("mk_s")) / F.sqrt(variance))),
    })
    out = out.withColumn("p", normal_two_sided(F.col("z")))
    clear = F.coalesce(F.col("p") < 0.05, F.lit(False))
    label = only(F.when(clear & (F.col("z") > 0), "increasing").when(clear, "decreasing").otherwise("no trend"))
    return out.select(*keys, "n", "mean", "slope", "low", "high", only(F.col("mk_s")).alias("mk_s"), "z", "p", label.alias("trend"))


def trend_rows(series: DataFrame, keys: list[str], family: list[str], x: str, y: str, block: int, replicates: int, seed: int) -> DataFrame:
    """One row a series: start, end, n, mean, slope per year and per decade with the interval of resampled residuals, p, q within its family, trend."""
    rows = numbered(series, keys, x, y)
    span = rows.groupBy(*keys).agg(F.min("t").cast("int").alias("start"), F.max("t").cast("int").alias("end"))
    rank = trend_summary(series, keys, x, y).select(*keys, "n", "mean", "slope", "p", "trend")
    fits = rows.join(rank.where("slope IS NOT NULL").select(*keys), keys, "left_semi")
    drawn = sen_bootstrap(fits.select(*keys, "t", "v"), keys, "t", "v", block, replicates, seed).select(*keys, "low", "high")
    out = bh_fdr(span.join(rank, keys).join(drawn, keys, "left"), "p", family)
    return out.select(*keys, "start", "end", "n", "mean", F.col("slope").alias("slope_year"), (F.col("slope") * 10).alias("slope_decade"), (F.col("low") * 10).alias("low_decade"), (F.col("high") * 10).alias("high_decade"), "p", "q", "trend")
