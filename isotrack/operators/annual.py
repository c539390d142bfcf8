"""Yearly metrics, shares, weights and contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annual_metrics(events: DataFrame, years: DataFrame, value: str, keys: list[str] = (), year: str = "season") -> DataFrame:
    """Events, entities, mean, median and quartiles per year of the spine; counts 0 and statistics null where empty."""
    per = events.groupBy(*keys, year).agg(
        F.count("*").alias("n_events"), F.countDistinct("sid").alias("n_entities"), F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.25)).alias("q25"), F.percentile(value, F.lit(0.75)).alias("q75"),
    )
    return years.join(per, [*keys, year], "left").na.fill({"n_events": 0, "n_entities": 0})


def category_shares(events: DataFrame, categories: DataFrame, category: str, by_entity: bool = False, year: str = "season") -> DataFrame:
    """Share of each category a year, 0 for absent ones; by events or by entities that have it."""
    one = F.countDistinct("sid") if by_entity else F.count("*")
    counts = events.groupBy(year, category).agg(one.alias("n"))
    full = events.select(year).distinct().crossJoin(categories).join(counts, [year, category], "left").na.fill({"n": 0})
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(year)))


def group_share(events: DataFrame, first: Column, second: Column, year: str = "season") -> DataFrame:
    """n(first) / (n(first) + n(second)) a year; null without either."""
    per = events.groupBy(year).agg(F.sum(first.cast("int")).alias("a"), F.sum(second.cast("int")).alias("b"))
    return per.select(year, F.try_divide(F.col("a"), F.col("a") + F.col("b")).alias("share"))


def leave_one_out(events: DataFrame, categories: DataFrame | None, category: str, value: str) -> DataFrame:
    """Mean of the value without each category in turn: all sums less the category's own.  ``categories`` may name more than occur."""
    per = events.groupBy(F.col(category).alias("excluded")).agg(F.sum(value).alias("s"), F.count(value).alias("k"), F.count("*").alias("n"))
    everything = Window.partitionBy()  # a row a category
    if categories is not None:
        per = categories.select(F.col(category).alias("excluded")).distinct().join(per, "excluded", "full").na.fill(0, ["s", "k", "n"])
    rest = {c: F.sum(c).over(everything) - F.col(c) for c in ("s", "k", "n")}
    return per.select("excluded", F.try_divide(rest["s"], rest["k"]).alias("mean"), rest["n"].alias("n"))


def year_weights(points: DataFrame, key: str = "cell_id", year: str = "season") -> DataFrame:
    """Entity-normalised, equal-year weights of keys: an entity's points share 1 over all its years."""
    own = points.groupBy("sid").agg(F.count("*").alias("n_sid"))
    rows = points.join(own, "sid").withColumn("w", 1 / F.col("n_sid"))
    mass = rows.groupBy(year, key).agg(F.sum("w").alias("w"))
    total = mass.groupBy(year).agg(F.sum("w").alias("effective"))
    return mass.join(total, year).select(year, key, (F.col("w") / F.col("effective")).alias("weight"), "effective")


def completeness(points: DataFrame, agency: str = "agency", year: str = "season") -> DataFrame:
    return points.groupBy(agency, year).agg(F.count("*").alias("n_rows"), F.countDistinct("sid").alias("n_sid"), F.max("iso_time").alias("last_time"), F.countDistinct(F.when(F.col("wind").isNotNull(), F.col("sid"))).alias("n_with_wind"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null for constant input or fewer than three pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(F.when(both, 1)) >= 3, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pairwise_corr(df: DataFrame, series: str, at: list[str], value: str) -> DataFrame:
    """Correlation of every two series over their common places."""
    a = df.select(*at, F.col(series).alias("first"), F.col(value).alias("x"))
    b = df.select(*at, F.col(series).alias("second"), F.col(value).alias("y"))
    return a.join(b, at).where("first < second").groupBy("first", "second").agg(safe_corr(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n"))
