"""Filters, labels, joins, reshapes and summaries of points and yearly tables, as column expressions and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages that are not tropical, and the classes of storm strength and above of two agencies.
NOT_TROPICAL = ("EX", "ET", "PT", "SS", "SD", "IN", "DS", "DB", "LO", "WV", "MD")
GRADES, CATEGORIES = (3, 4, 5, 9), (2, 3, 4, 5, 6)


def between_left(x: Column, low: float, high: float) -> Column:
    """low <= x < high."""
    return (x >= low) & (x < high)


def without_word(text: Column, word: str) -> Column:
    """Texts that do not contain ``word`` in any case; null does not."""
    return ~F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(word.lower()))


def native_stage(agency: Column, wind: Column, status: Column, grade: Column) -> Column:
    """Storm strength by each agency's own convention; null status is no excluded stage, null grade no storm."""
    usa = (wind >= 34) & ~F.upper(F.trim(F.coalesce(status, F.lit("")))).isin(*NOT_TROPICAL)
    own = F.when(agency == "USA", usa).when(agency == "TOKYO", grade.isin(*GRADES)).when(agency == "CMA", grade.isin(*CATEGORIES))
    return F.coalesce(own, F.lit(False))


def in_months(at: Column, *months: int) -> Column:
    return F.month(at).isin(*months)


def season_of_id(sid: Column) -> Column:
    """The year that an id begins with; null if it begins with none."""
    return F.substring(sid, 1, 4).try_cast("int")


def threshold_labels(df: DataFrame, label: str, distance: str, thresholds: list[float]) -> DataFrame:
    """Each row once per threshold: its label if near enough, else Other.  Rows grow by the few thresholds only."""
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.withColumn(label, F.when(F.col(distance) <= F.col("threshold"), F.col(label)).otherwise("Other"))


def labelled(df: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Each row once per labelling: aggregation (its name) and bin."""
    return df.withColumn("l", F.explode(F.array(*[F.struct(F.lit(n).alias("aggregation"), c.alias("bin")) for n, c in labels.items()]))).select("*", "l.*").drop("l")


def ladder(x: Column, edges: list[float], names: list[str]) -> Column:
    """Labels of half-open bins with open ends: names has one more than edges."""
    return reduce(lambda c, pair: c.when(x < pair[0], pair[1]), zip(edges[1:], names[1:-1]), F.when(x < edges[0], names[0])).when(x.isNotNull(), names[-1])


def raster_state(points: DataFrame, raster: DataFrame, lon0: float, lat1: float, res: float) -> DataFrame:
    """Points with ``land`` of their raster cell (row, col, land), null outside.  Places are cut towards 0,
    so points up to one cell west or north of the raster count as its first column or row."""
    at = points.withColumns({"col": ((F.col("lon") - lon0) / res).cast("int"), "row": ((F.lit(lat1) - F.col("lat")) / res).cast("int")})
    return at.join(raster.select("row", "col", "land"), ["row", "col"], "left").drop("row", "col")


def raster_class(points: DataFrame, raster: DataFrame, lon0: float, lat1: float, res: float, rows: int, cols: int) -> DataFrame:
    """Points with ``state`` 1 (land), 0 (sea) or -1 (outside); the east and south edges belong to the last cells."""
    x, y = (F.col("lon") - lon0) / res, (F.lit(lat1) - F.col("lat")) / res
    inside = x.between(0, cols) & y.between(0, rows)
    at = points.withColumns({"col": F.when(inside, F.least(F.floor(x), F.lit(cols - 1))).cast("int"), "row": F.when(inside, F.least(F.floor(y), F.lit(rows - 1))).cast("int")})
    found = at.join(raster.select("row", "col", "land"), ["row", "col"], "left")
    return found.withColumn("state", F.when(F.col("row").isNull(), -1).otherwise(F.coalesce(F.col("land").cast("int"), F.lit(0)))).drop("row", "col", "land")


def star_join(base: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Yearly tables side by side; years that any of them lacks are left out."""
    return reduce(lambda a, b: a.join(b, key), tables, base)


def endpoint_states(segments: DataFrame, states: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same table of states joined to both ends of each segment: start_<value> and end_<value>.

    Segments hold start_<key> and end_<key> of every key; an end without state gives null.
    """
    for end in ("start", "end"):
        side = states.select(*[F.col(k).alias(f"{end}_{k}") for k in keys], F.col(value).alias(f"{end}_{value}"))
        segments = segments.join(side, [f"{end}_{k}" for k in keys], "left")
    return segments


def reattach(exact: DataFrame, unresolved: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``exact`` with the unresolved rows of ``source`` added; of rows that share the keys, the first by ``order`` stays."""
    rows = exact.unionByName(source.join(unresolved.select(*keys).distinct(), keys), allowMissingColumns=True)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def demean(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """x less its group's mean."""
    return df.withColumn(out, F.col(x) - F.avg(x).over(Window.partitionBy(*keys)))


def standardised(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """x in units of its group's sample (z1) and population (z0) deviation; null where that is 0."""
    own = Window.partitionBy(*keys)
    apart = F.col(x) - F.avg(x).over(own)
    return df.withColumns({"z1": F.try_divide(apart, F.stddev_samp(x).over(own)), "z0": F.try_divide(apart, F.stddev_pop(x).over(own))})


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k).drop("place")


def nested_sizes(df: DataFrame, outer: str, inner: list[str]) -> DataFrame:
    """Per outer group: its rows, its inner groups, and the inner groups' mean size."""
    sizes = df.groupBy(outer, *inner).agg(F.count("*").alias("n"))
    return sizes.groupBy(outer).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.avg("n").alias("mean_size"))


def share_with_rules(df: DataFrame, year: str, north: Column, south: Column, between: Column) -> DataFrame:
    """North share by year under three rules for the group between, and with all events below the line; null without any."""
    n, s, b = (F.sum(F.when(c, 1).otherwise(0)) for c in (north, south, between))
    return df.groupBy(year).agg(
        F.try_divide(n, n + s).alias("left_out"), F.try_divide(n + b, n + s + b).alias("as_north"), F.try_divide(n, n + s + b).alias("as_south"), F.try_divide(n, F.count("*")).alias("of_all"),
    )


def sign_robustness(df: DataFrame, keys: list[str], value: str, low: str, high: str) -> DataFrame:
    """How many estimates are positive or negative, how many intervals leave 0 out, and the range."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*keys).agg(
        n(F.col(value) > 0).alias("n_positive"), n(F.col(value) < 0).alias("n_negative"), n((F.col(low) > 0) | (F.col(high) < 0)).alias("n_clear"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def factor_sensitivity(shifts: DataFrame, keys: list[str], shift: str) -> DataFrame:
    size = F.abs(F.col(shift))
    return shifts.groupBy(*keys).agg(F.avg(shift).alias("mean"), F.median(shift).alias("median"), F.min(shift).alias("least"), F.max(shift).alias("most"), F.median(size).alias("median_abs"), F.max(size).alias("max_abs"))


def segment_means(df: DataFrame, year: str, first: int, length: int, y: str) -> DataFrame:
    """Means over segments of ``length`` years, only complete ones, and which is the highest."""
    out = df.withColumn("segment", F.floor((F.col(year) - first) / length)).groupBy("segment").agg(F.avg(y).alias("mean"), F.countDistinct(year).alias("n_years")).where(F.col("n_years") == length)
    return out.withColumn("peak", F.col("mean") == F.max("mean").over(Window.partitionBy()))


def leave_one_range(effects: DataFrame, full: DataFrame) -> DataFrame:
    """Which exclusion leaves the least and the most, and the least's part of the full effect.  effects: (excluded, effect); full: (effect)."""
    span = effects.agg(F.min_by("excluded", "effect").alias("least_without"), F.min("effect").alias("least"), F.max_by("excluded", "effect").alias("most_without"), F.max("effect").alias("most"))
    return span.crossJoin(full.select(F.col("effect").alias("full"))).withColumn("retained", F.try_divide("least", "full"))


def membership_overlap(df: DataFrame, period: str, group: str, groups: list[str], sid: str) -> DataFrame:
    """Per period: entities that each group, each pair and all groups have in common, and their part of all."""
    has = df.groupBy(period, sid).agg(*[F.max((F.col(group) == g).cast("int")).alias(g) for g in groups])
    n = lambda *cols: F.sum(reduce(lambda a, b: a * b, map(F.col, cols)))
    pairs = [(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]]
    return has.groupBy(period).agg(
        F.count("*").alias("n_any"), *[n(g).alias(f"n_{g}".lower()) for g in groups], *[n(a, b).alias(f"n_{a}_{b}".lower()) for a, b in pairs], n(*groups).alias("n_all"), F.try_divide(n(*groups), F.count("*")).alias("part_all"),
    )


def hitting_both(df: DataFrame, sid: str, first: Column, second: Column) -> DataFrame:
    """Entities with rows of both kinds."""
    return df.groupBy(sid).agg(F.max(first.cast("int")).alias("a"), F.max(second.cast("int")).alias("b")).where("a = 1 AND b = 1").select(sid)


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, which belongs to the last, and the median."""
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.median(x).alias("median"))
    at = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(span))  # one row
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(x) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int")
    return at.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.first("median").alias("median"))


def seam_differences(series: DataFrame, year: str, y: str, seam: int) -> DataFrame:
    """Differences from year to year; ``reference`` is false for the one into the seam year."""
    w = Window.orderBy(year)  # a row a year
    out = series.withColumn("difference", F.lead(y).over(w) - F.col(y)).withColumn("to_season", F.lead(year).over(w)).where("difference IS NOT NULL")
    return out.select("to_season", "difference", (F.col("to_season") != seam).alias("reference"))


def absolute_percentile(value: Column, reference: DataFrame, y: str) -> DataFrame:
    """Part of the reference that is at least as far from 0 as ``value`` is not: (1 + number no farther) / (1 + n)."""
    return reference.agg(((F.sum(F.when(F.abs(F.col(y)) <= F.abs(value), 1).otherwise(0)) + 1) / (F.count(y) + 1)).alias("percentile"))


def relabel(df: DataFrame, cluster: str, weight: Column, x: str) -> DataFrame:
    """Old cluster numbers and new ones, by rising weighted mean of x."""
    mean = df.groupBy(cluster).agg((F.sum(weight * F.col(x)) / F.sum(weight)).alias("mean"))
    return mean.withColumn("label", F.row_number().over(Window.orderBy("mean", cluster)) - 1)


def checks(*parts: tuple[str, DataFrame, Column]) -> DataFrame:
    """One row for each check: name, passed, value.  A part is a name, a one-row table with ``value``, and the condition."""
    rows = [df.select(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), F.col("value").cast("double").alias("value")) for n, df, ok in parts]
    return reduce(DataFrame.unionByName, rows)


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in place of those of ``registry`` with the same key, and the rest as it is."""
    return registry.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def coverage_gaps(df: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """What the spine has and the table lacks."""
    return spine.join(df.select(*keys).distinct(), keys, "left_anti")


def interval_sign(low: Column, high: Column) -> Column:
    return F.when(low > 0, "positive").when(high < 0, "negative").when(low.isNotNull() & high.isNotNull(), "overlaps_zero")


def sum_closure(parts: DataFrame, whole: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Whether the parts of every key add up to its whole value; a missing whole does not close."""
    sums = parts.groupBy(*keys).agg(F.sum(value).alias("total"))
    both = sums.join(whole.select(*keys, F.col(value).alias("whole")), keys, "full")
    return both.withColumn("closes", F.coalesce(F.abs(F.col("total") - F.col("whole")) <= tolerance, F.lit(False)))


def whitespace_table(lines: DataFrame, names: list[str]) -> DataFrame:
    """Lines of a text table (``value``) split at white space; lines whose first field is no number are left out."""
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    out = parts.select(*[F.get("p", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])
    return out.where(F.col(names[0]).isNotNull())
