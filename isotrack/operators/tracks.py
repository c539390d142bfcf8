"""Ordered analytics along each entity's points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, great_circle_km, lon_difference
from .joins import numbered

ORDER = ["iso_time", "event_id"]


def hours(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)


def in_order(*keys: str):
    return Window.partitionBy(*(keys or ("sid",))).orderBy(*ORDER)


def keep_last(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each entity in the given order: genesis, first named, strongest."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def segments(df: DataFrame, max_gap_hours: float = 12.0) -> DataFrame:
    """Consecutive points of an entity with 0 < gap <= max: distance, hours, speeds at the segment's start."""
    w = in_order()
    out = df.withColumns({f"{c}2": F.lead(c).over(w) for c in ("iso_time", "lat", "lon")})
    out = out.withColumn("dt_h", hours(F.col("iso_time"), F.col("iso_time2"))).where((F.col("dt_h") > 0) & (F.col("dt_h") <= max_gap_hours))
    out = out.where("lat IS NOT NULL AND lon IS NOT NULL AND lat2 IS NOT NULL AND lon2 IS NOT NULL")
    mid = F.radians((F.col("lat") + F.col("lat2")) / 2)
    km = EARTH_KM * F.radians(F.lit(1.0))
    return out.withColumns({
        "dist_km": great_circle_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")),
        "v_kmh": (F.col("lat2") - F.col("lat")) * km / F.col("dt_h"),
        "u_kmh": lon_difference(F.col("lon"), F.col("lon2")) * km * F.cos(mid) / F.col("dt_h"),
    })


def mean_speed(df: DataFrame, max_gap_hours: float = 12.0) -> DataFrame:
    """Sum of distance over sum of time, and path length, per entity."""
    return segments(df, max_gap_hours).groupBy("sid").agg((F.sum("dist_km") / F.sum("dt_h")).alias("trans_speed"), F.sum("dist_km").alias("path_km"), F.count("*").alias("n_segments"))


def entity_summary(df: DataFrame, threshold: float, super_threshold: float) -> DataFrame:
    """Genesis, strongest point (first of ties), energy, flags and gaps per entity."""
    w = in_order()
    strong = F.col("wind") >= threshold
    first = F.min(F.when(strong, F.struct("iso_time", "event_id", "lat", "lon")))
    top = F.min(F.when(F.col("wind").isNotNull(), F.struct((-F.col("wind")).alias("neg"), "iso_time", "event_id", "lat", "lon")))
    gaps = df.withColumn("gap", hours(F.lag("iso_time").over(w), F.col("iso_time")))
    out = gaps.groupBy("sid").agg(
        first.alias("g"), top.alias("t"), (F.sum(F.when(strong, F.col("wind") * F.col("wind"))) * F.lit(1e-4)).alias("ace"), F.max("gap").alias("max_gap_h"),
        F.count("*").alias("n_points"), F.avg(F.col("wind").isNotNull().cast("double")).alias("valid_frac"), F.max("wind").alias("lmi"),
    )
    return out.select(
        "sid", F.col("g.iso_time").alias("genesis_time"), F.col("g.lat").alias("genesis_lat"), F.col("g.lon").alias("genesis_lon"), "lmi", F.col("t.iso_time").alias("lmi_time"),
        F.col("t.lat").alias("lmi_lat"), "ace", (F.col("lmi") >= super_threshold).cast("int").alias("is_super"), "max_gap_h", "n_points", "valid_frac",
    )


def unwrap_lon(df: DataFrame, out: str = "ulon") -> DataFrame:
    """Longitude without jumps of more than 180 degrees along each entity."""
    w = in_order()
    step = F.col("lon") - F.lag("lon").over(w)
    df = df.withColumn("__turn", F.when(step > 180, -360.0).when(step < -180, 360.0).otherwise(0.0))
    return df.withColumn(out, F.col("lon") + F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turn")


def turning_points(df: DataFrame, min_points: int = 6, ahead: int = 4, min_hours: float = 24.0, min_lat: float = 20.0) -> DataFrame:
    """First point from which the smoothed track turns east and north; entities without one give no row."""
    w = in_order()
    near = w.rowsBetween(-1, 1)
    df = unwrap_lon(df).withColumns({"slat": F.avg("lat").over(near), "slon": F.avg("ulon").over(near), "i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("sid"))})
    df = df.withColumn("west", F.min("slon").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({f"{c}_a": F.lead(c, ahead).over(w) for c in ("iso_time", "slat", "slon")})
    df = df.where((F.col("n") >= min_points) & (F.col("i") >= 1) & (F.col("i") < F.col("n") - ahead) & (F.col("slat") >= min_lat))
    df = df.where((hours(F.col("iso_time"), F.col("iso_time_a")) >= min_hours) & (F.col("slon") <= F.col("west") + 0.5) & (F.col("slon_a") - F.col("slon") >= 2) & (F.col("slat_a") - F.col("slat") >= 2))
    return first_by(df, ["sid"], [F.col("i")]).select("sid", F.col("iso_time").alias("turn_time"), F.col("slat").alias("turn_lat"), F.col("slon").alias("turn_lon"))


def min_separation(df: DataFrame, hours_apart: float = 12.0, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Keep an event only if it is far enough from the last one kept.

    An event after a gap of that length is kept in any case, so the fold over sorted events starts anew there:
    only a run of events without such a gap travels as one array.
    """
    gap = int(hours_apart * 3.6e9)
    stamp = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("iso_time"))
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    times = df.select(*keys, stamp.alias("t"), "event_id").withColumn("fresh", (F.col("t") - F.lag("t").over(w) >= gap).cast("int"))
    times = times.withColumn("run", F.sum(F.coalesce("fresh", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = times.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("e"))
    empty = F.array().cast("array<struct<t:bigint,event_id:bigint>>")

    def step(kept: Column, e: Column) -> Column:
        return F.when((F.size(kept) == 0) | (e["t"] - F.element_at(kept, -1)["t"] >= gap), F.concat(kept, F.array(e))).otherwise(kept)

    kept = runs.select(*keys, F.explode(F.aggregate("e", empty, step)).alias("e"))
    return df.join(kept.select(*keys, F.col("e.event_id").alias("event_id")), [*keys, "event_id"], "left_semi")


def resample(df: DataFrame, n: int = 20) -> DataFrame:
    """Each entity's path at n equal steps of its duration, linearly between points: sid, k, lat, lon."""
    w = in_order()
    life = Window.partitionBy("sid")
    df = unwrap_lon(df).withColumn("h", hours(F.min("iso_time").over(life), F.col("iso_time"))).withColumn("life", F.max("h").over(life)).withColumn("n_pts", F.count("*").over(life))
    df = df.where((F.col("n_pts") >= 4) & (F.col("life") > 0)).withColumns({f"{c}2": F.lead(c).over(w) for c in ("h", "lat", "ulon")})
    df = df.where("h2 > h")
    low = F.ceil(F.col("h") / F.col("life") * (n - 1) - 1e-9)
    high = F.when(F.col("h2") >= F.col("life"), F.lit(n - 1)).otherwise(F.ceil(F.col("h2") / F.col("life") * (n - 1) - 1e-9) - 1)
    df = df.withColumn("lo", low).withColumn("hi", high).where("hi >= lo").withColumn("k", F.explode(F.sequence("lo", "hi")))
    f = (F.col("k") * F.col("life") / (n - 1) - F.col("h")) / (F.col("h2") - F.col("h"))
    return df.select("sid", F.col("k").cast("int").alias("k"), (F.col("lat") + f * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("ulon") + f * (F.col("ulon2") - F.col("ulon"))).alias("lon"))


def densify(segs: DataFrame, max_step: float) -> DataFrame:
    """Points along each segment, at most max_step degrees apart: adds k, f, dlat, dlon."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lat2") - F.col("lat")), F.abs(F.col("lon2") - F.col("lon"))) / max_step)).cast("int")
    out = segs.withColumn("n_steps", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_steps")))).withColumn("f", F.col("k") / F.col("n_steps"))
    return out.withColumns({"dlat": F.col("lat") + F.col("f") * (F.col("lat2") - F.col("lat")), "dlon": F.col("lon") + F.col("f") * (F.col("lon2") - F.col("lon"))})


def crossings(segs: DataFrame, is_land: Column, max_step: float) -> DataFrame:
    """First sea-to-land step of each segment; ``is_land`` is an expression on dlat and dlon."""
    w = Window.partitionBy("sid", "event_id").orderBy("k")
    steps = densify(segs, max_step).withColumn("land", is_land).withColumn("was", F.lag("land").over(w)).where("land AND NOT was")
    return first_by(steps, ["sid", "event_id"], [F.col("k")])


def year_blocks(years: DataFrame, block: int, year: str = "season") -> DataFrame:
    """Block numbers of consecutive years; no block spans a gap."""
    w = Window.orderBy(year)
    df = years.withColumn("island", F.col(year) - F.row_number().over(w))
    df = df.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("island").orderBy(year)) - 1) / block))
    return df.withColumn("block", F.dense_rank().over(Window.orderBy("island", "part")) - 1).select(year, "block")


def rank_remap(target: DataFrame, donor: DataFrame, value: str) -> DataFrame:
    """Replace each target value by the donor's quantile at its mid-rank; rows are numbered across tasks."""
    ranked, steps = numbered(target, [value, "sid"], "__r"), numbered(donor.select(F.col(value).alias("__v")), ["__v"], "__i")
    n, m = (F.broadcast(df.agg(F.count("*").alias(c))) for df, c in ((target, "__n"), (donor, "__m")))
    at = ranked.crossJoin(n).crossJoin(m).withColumn("__pos", (F.col("__r") + 0.5) / F.col("__n") * (F.col("__m") - 1)).withColumn("__low", F.floor("__pos"))
    side = lambda c: steps.select(F.col("__i").alias(f"__{c}"), F.col("__v").alias(c))
    out = at.withColumn("__high", F.least(F.col("__low") + 1, F.col("__m") - 1)).join(side("low"), "__low").join(side("high"), "__high")
    return out.select("sid", (F.col("low") + (F.col("__pos") - F.col("__low")) * (F.col("high") - F.col("low"))).alias("remapped"))
