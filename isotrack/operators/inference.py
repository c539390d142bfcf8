"""Trends, resampling tests and regression as plans over replicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import student_two_sided


def bh_fdr(df: DataFrame, p: str, family: list[str], out: str = "q") -> DataFrame:
    """Benjamini-Hochberg values within each family; null p stays null.

    Equal p values are counted first, so what is sorted is a family's different values; from a permutation test
    these are no more than its shuffles, however many tests there are.
    """
    names = [f"__f{i}" for i in range(len(family))]
    per = df.where(F.col(p).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(family, names)], F.col(p).alias("__p")).agg(F.count("*").alias("__c"))
    up = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*names).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("__x", F.col("__p") * F.sum("__c").over(Window.partitionBy(*names)) / F.sum("__c").over(up))
    per = per.select(*names, "__p", F.least(F.lit(1.0), F.min("__x").over(down)).alias(out))
    same = F.col(p) == F.col("__p")
    for c, n in zip(family, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return df.join(per, same, "left").drop("__p", *names)


def theil_sen(series: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median of pairwise slopes and the Mann-Kendall sum per series (a series is years, a short table)."""
    a = series.select(*keys, F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = series.select(*keys, F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).where("x1 < x2 AND y1 IS NOT NULL AND y2 IS NOT NULL")
    return pairs.groupBy(*keys).agg(F.percentile((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")), F.lit(0.5)).alias("slope"), F.sum(F.signum(F.col("y2") - F.col("y1"))).alias("mk_s"))


def detrend(df: DataFrame, keys: list[str], x: str, y: str, out: str = "resid") -> DataFrame:
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__i"))
    return df.join(fit, keys).withColumn(out, F.col(y) - F.col("__i") - F.col("__s") * F.col(x)).drop("__s", "__i")


def ar1(df: DataFrame, order: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Lag-one correlation of each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = df.withColumn("__b", F.lag(y).over(w)).where(F.col("__b").isNotNull())
    r = F.try_divide(F.covar_pop(y, "__b"), F.stddev_pop(y) * F.stddev_pop("__b"))
    return pairs.groupBy(*keys).agg(r.alias("ar1"), F.count("*").alias("n_pairs"))


def effective_n(n: Column, r1: Column, r2: Column) -> Column:
    return F.least(n.cast("double"), F.greatest(F.lit(3.0), n * (1 - r1 * r2) / (1 + r1 * r2)))


def block_positions(blocks: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Years of each replicate after its blocks are shuffled by a hash: (rep, position, season).

    Replicate 0 keeps the order.  Work is replicates x years, spread over replicates.
    """
    spark = blocks.sparkSession
    reps = spark.range(replicates + 1).select(F.col("id").cast("int").alias("rep"))
    order = F.when(F.col("rep") == 0, F.lpad(F.col("block").cast("string"), 8, "0")).otherwise(F.md5(F.concat_ws("_", F.lit(seed), F.col("rep"), F.col("block"))))
    rows = reps.crossJoin(F.broadcast(blocks)).withColumn("o", order)
    return rows.select("rep", "season", (F.row_number().over(Window.partitionBy("rep").orderBy("o", "block", "season")) - 1).alias("position"))


def permutation_difference(series: DataFrame, blocks: DataFrame, n_early: int, replicates: int, seed: int, y: str) -> DataFrame:
    """Late minus early mean, and the share of block shuffles at least as far from 0 (one added)."""
    placed = block_positions(blocks, replicates, seed).join(F.broadcast(series.select("season", y)), "season")
    per = placed.groupBy("rep").agg((F.avg(F.when(F.col("position") >= n_early, F.col(y))) - F.avg(F.when(F.col("position") < n_early, F.col(y)))).alias("d"))
    seen = per.where("rep = 0").select(F.col("d").alias("observed"))
    return per.where("rep > 0").join(F.broadcast(seen)).agg(F.max("observed").alias("difference"), ((F.sum((F.round(F.abs("d"), 9) >= F.round(F.abs("observed"), 9)).cast("int")) + 1) / F.lit(replicates + 1.0)).alias("p_value"))


def shuffled_weights(blocks: DataFrame, n_early: int, replicates: int, seed: int) -> DataFrame:
    """(rep, weights): by season, 1/late years or -1/early years as a map, so that a replicate is one row."""
    n = F.count("*").over(Window.partitionBy("rep"))
    placed = block_positions(blocks, replicates, seed).withColumn("w", F.when(F.col("position") >= n_early, 1 / (n - n_early)).otherwise(-1.0 / n_early))
    return placed.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("season", "w"))).alias("weights"))


def shuffled_changes(shares: DataFrame, blocks: DataFrame, n_early: int, replicates: int, seed: int) -> DataFrame:
    """(rep, cell_id, d): late minus early mean of each cell in each replicate.

    A cell's years are one array (cells and years are bounded by the grid and the record), so replicates meet
    cells, not their rows.
    """
    cells = shares.groupBy("cell_id").agg(F.collect_list(F.struct("season", "share")).alias("years"))
    reps = shuffled_weights(blocks, n_early, replicates, seed)
    d = F.aggregate("years", F.lit(0.0), lambda t, y: t + F.element_at("weights", y["season"]) * y["share"])
    return reps.crossJoin(cells).select("rep", "cell_id", d.alias("d"))


def permutation_tv(shares: DataFrame, blocks: DataFrame, n_early: int, replicates: int, seed: int) -> DataFrame:
    """Total variation between the periods, and its block-shuffle p value."""
    tv = shuffled_changes(shares, blocks, n_early, replicates, seed).groupBy("rep").agg((F.lit(0.5) * F.sum(F.abs("d"))).alias("tv"))
    seen = tv.where("rep = 0").select(F.col("tv").alias("observed"))
    return tv.where("rep > 0").join(F.broadcast(seen)).agg(F.max("observed").alias("tv"), ((F.sum((F.round("tv", 9) >= F.round("observed", 9)).cast("int")) + 1) / F.lit(replicates + 1.0)).alias("p_value"))


def composition_test(shares: DataFrame, blocks: DataFrame, n_early: int, replicates: int, seed: int) -> DataFrame:
    """Per cell: change, two-sided p, BH q, and p of the greatest change of any cell.  A year's shares must sum to 1."""
    if not shares.groupBy("season").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-8").isEmpty():
        raise ValueError("each year's shares must sum to one")
    d = shuffled_changes(shares, blocks, n_early, replicates, seed).withColumn("size", F.round(F.abs("d"), 9))
    d = d.withColumn("top", F.max("size").over(Window.partitionBy("rep")))
    seen = d.where("rep = 0").select("cell_id", F.col("d").alias("change"), F.col("size").alias("own"))
    part = lambda c: (F.sum((F.col(c) >= F.col("own")).cast("int")) + 1) / F.lit(replicates + 1.0)
    cells = d.where("rep > 0").join(seen, "cell_id").groupBy("cell_id").agg(F.first("change").alias("change"), part("size").alias("p"), part("top").alias("p_max"))
    return bh_fdr(cells, "p", [])


def correlation_permutation(series: DataFrame, blocks: DataFrame, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """Correlation as it is, of detrended series, and the block-shuffle p value of the latter."""
    s = detrend(detrend(series.withColumn("__k", F.lit(1)), ["__k"], "season", x, "dx"), ["__k"], "season", y, "dy")
    order = s.select("season", "dx", "dy", x, y, (F.row_number().over(Window.orderBy("season")) - 1).alias("position"))  # a row a year
    placed = block_positions(blocks, replicates, seed).join(F.broadcast(order.select("season", "dx")), "season").join(F.broadcast(order.select("position", "dy")), "position")
    r = placed.groupBy("rep").agg(F.corr("dx", "dy").alias("r"))
    seen = r.where("rep = 0").select(F.col("r").alias("observed"))
    p = r.where("rep > 0").join(F.broadcast(seen)).agg(F.max("observed").alias("r_detrended"), ((F.sum((F.round(F.abs("r"), 9) >= F.round(F.abs("observed"), 9)).cast("int")) + 1) / F.lit(replicates + 1.0)).alias("p_value"))
    return series.agg(F.corr(x, y).alias("r"), F.count("*").alias("n")).crossJoin(p)


def stratified_labels(years: DataFrame, n_early: int, replicates: int, seed: int) -> DataFrame:
    """(rep, season, early): the early label dealt to ``n_early`` of the years at random; replicate 0 takes the first."""
    reps = years.sparkSession.range(replicates + 1).select(F.col("id").cast("int").alias("rep"))
    order = F.when(F.col("rep") == 0, F.lpad(F.col("season").cast("string"), 8, "0")).otherwise(F.md5(F.concat_ws("_", F.lit(seed), "rep", "season")))
    rows = reps.crossJoin(F.broadcast(years)).withColumn("o", order)
    return rows.select("rep", "season", (F.row_number().over(Window.partitionBy("rep").orderBy("o", "season")) <= n_early).alias("early"))


def sen_bootstrap(series: DataFrame, keys: list[str], x: str, y: str, block: int, replicates: int, seed: int) -> DataFrame:
    """Theil-Sen slope and its interval: residuals are drawn again in blocks of years, the years stay."""
    slope = theil_sen(series, keys, x, y).select(*keys, "slope")
    fit = series.join(slope, keys)
    fit = fit.join(fit.groupBy(*keys).agg(F.median(F.col(y) - F.col("slope") * F.col(x)).alias("base")), keys)
    w = Window.partitionBy(*keys).orderBy(x)
    fit = fit.select(*keys, x, "slope", (F.col("base") + F.col("slope") * F.col(x)).alias("line"), F.col(y).alias("y"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    draws = fit.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    start = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(seed), *keys, "rep", F.floor(F.col("i") / block))), 1, 8), 16, 10).cast("long")
    draws = draws.withColumn("j", (start % (F.col("n") - F.least(F.lit(block), F.col("n")) + 1) + F.col("i") % block).cast("int"))
    resid = fit.select(*keys, F.col("i").alias("j"), (F.col("y") - F.col("line")).alias("resid"))
    drawn = draws.join(resid, [*keys, "j"]).select(*keys, "rep", x, (F.col("line") + F.col("resid")).alias("v"))
    each = theil_sen(drawn, [*keys, "rep"], x, "v")
    span = each.groupBy(*keys).agg(F.percentile("slope", F.lit(0.025)).alias("low"), F.percentile("slope", F.lit(0.975)).alias("high"))
    return slope.join(span, keys)


def student_p(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function by its continued fraction."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0  # from the innermost fraction outward
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = odd / (1 + even / (1 + value))
    return front / (1 + value)


def effective_correlation(series: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Correlation, effective number of years by both lag-one correlations, and the t value for it."""
    whole = series.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    out = whole.join(ar1(series, order, x, keys).select(*keys, F.col("ar1").alias("a")), keys).join(ar1(series, order, y, keys).select(*keys, F.col("ar1").alias("b")), keys)
    out = out.withColumn("n_eff", effective_n(F.col("n"), F.col("a"), F.col("b")))
    return out.withColumn("t", F.col("r") * F.sqrt((F.col("n_eff") - 2) / (1 - F.col("r") * F.col("r")))).drop("a", "b")


def with_student_p(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, n_eff, t) with the two-sided p value at n_eff - 2 degrees of freedom, 1 at least."""
    return df.select(*keys, "r", "n_eff", "t", student_two_sided(F.col("t"), F.greatest(F.col("n_eff") - 2, F.lit(1.0))).alias("p"))


def shared_slope(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Least squares of several responses on their own predictors with one slope and an intercept each: alpha, beta1, beta2, ..."""
    rise = sum((F.covar_pop(x, y) for x, y in pairs[1:]), F.covar_pop(*pairs[0]))
    run = sum((F.var_pop(x) for x, _ in pairs[1:]), F.var_pop(pairs[0][0]))
    sums = df.agg(F.try_divide(rise, run).alias("alpha"), *[F.avg(c).alias(f"m_{c}") for pair in pairs for c in pair])
    return sums.select("alpha", *[(F.col(f"m_{y}") - F.col("alpha") * F.col(f"m_{x}")).alias(f"beta{i}") for i, (x, y) in enumerate(pairs, 1)])


def ols(df: DataFrame, y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """Least squares with intercept: sums of products are aggregated in parallel, the small system is solved in one task."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(cols)
    sums = df.na.drop(subset=[y, *xs]).agg(*[F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(w * cols[i] * F.col(y)).alias(f"b{i}") for i in range(k)])
    names = ["const", *xs]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
                beta = np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(k)], float), rcond=None)[0]
                yield pd.DataFrame({"term": names, "coef": beta})

    return sums.mapInPandas(solve, "term string, coef double")


def robust_z(df: DataFrame, y: str) -> DataFrame:
    """(y - median) / (1.4826 MAD); where the spread is 0, 0 at the median and infinite elsewhere."""
    m = df.agg(F.median(y).alias("__m"))
    d = df.join(F.broadcast(m)).withColumn("__d", F.abs(F.col(y) - F.col("__m")))
    s = d.agg((F.median("__d") * F.lit(1.4826)).alias("__s"))
    return d.join(F.broadcast(s)).withColumn("z", F.when(F.col("__s") == 0, F.when(F.col(y) == F.col("__m"), 0.0).otherwise(float("inf"))).otherwise(F.try_divide(F.col(y) - F.col("__m"), F.col("__s")))).drop("__m", "__d", "__s")


def fuzzy_membership(df: DataFrame, vector: str, centers: list[list[float]], m: float = 2.0) -> DataFrame:
    """Membership of every row in fixed centers, as an array that sums to 1; all null where the vector or one of its components is null."""
    dist = F.array(*[F.sqrt(F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)) for c in centers])
    df = df.withColumn("__d", F.transform(dist, lambda d: F.when(d.isNotNull(), F.pow(F.greatest(d, F.lit(1e-12)), -2.0 / (m - 1.0)))))
    total = F.aggregate("__d", F.lit(0.0), lambda t, x: t + x)
    return df.withColumn("membership", F.transform("__d", lambda d: d / total)).drop("__d")


def block_bootstrap(series: DataFrame, y: str, length: int, block: int, replicates: int, seed: int, early: tuple[int, int], late: tuple[int, int], year: str = "season") -> DataFrame:
    """Interval of the late minus early mean from circular blocks of years, drawn by a hash per period and replicate.

    ``length`` years of each period are drawn; a replicate is rows of its own, so work spreads over replicates.
    """
    spark = series.sparkSession
    place = Window.partitionBy("period").orderBy(year)
    own = series.withColumn("period", F.when(F.col(year).between(*early), "e").when(F.col(year).between(*late), "l")).where("period IS NOT NULL")
    own = own.select("period", (F.row_number().over(place) - 1).alias("i"), F.count("*").over(Window.partitionBy("period")).alias("n"), y)
    draws = spark.range(replicates).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k"))
    draws = draws.crossJoin(F.broadcast(own.select("period", "n").distinct()))
    start = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(seed), "period", "rep", F.floor(F.col("k") / block))), 1, 8), 16, 10).cast("long")
    draws = draws.withColumn("i", ((start + F.col("k") % block) % F.col("n")).cast("int"))
    means = draws.join(F.broadcast(own.select("period", "i", y)), ["period", "i"]).groupBy("rep").agg((F.avg(F.when(F.col("period") == "l", F.col(y))) - F.avg(F.when(F.col("period") == "e", F.col(y)))).alias("d"))
    return means.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
