"""Joins on brackets, nearest times, neighbouring cells, and checked keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, great_circle_km
from ..functions.scratch import cut


def safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides are first checked to have unique keys where ``validate`` says "one"."""
    for side, df, unique in (("left", left, validate.startswith("one")), ("right", right, validate.endswith("one"))):
        if unique and not df.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"duplicate keys on the {side} side: {', '.join(on)}")
    return left.join(right, on, how)


def bracket_join(events: DataFrame, segs: DataFrame, keys: list[str], at: str, start: str, end: str, bucket_hours: int = 24) -> DataFrame:
    """Each event with the first segment of its entity that holds its time.

    Besides the keys, both sides are matched on time buckets that the segment
    touches, so that a busy entity is not compared with all of its segments.
    """
    slot = lambda c: F.floor(F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), c) / bucket_hours)
    wide = segs.withColumn("__slot", F.explode(F.sequence(slot(F.col(start)), slot(F.col(end)))))
    out = events.withColumn("__slot", slot(F.col(at))).join(wide, [*keys, "__slot"]).where(F.col(at).between(F.col(start), F.col(end)))
    w = Window.partitionBy(*keys, "probe_id").orderBy(start, end)
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__slot")


def nearest_time_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_time: str, right_time: str, tie: str) -> DataFrame:
    """Each left row with the right row of its entity that is nearest in time; earlier, then smaller, wins ties.

    Both sides are sorted together once; a left row's nearest is the last right row before it or the first after
    it, so work grows with the rows, not with their pairs.  ``right`` brings its keys, time and tie only.
    """
    a = left.select(*keys, F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("own"), F.struct(*left.columns).alias("row"))
    b = right.select(*keys, F.col(right_time).alias("t"), F.lit(0).alias("side"), F.col(tie).cast("long").alias("own"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    rows = a.unionByName(b).withColumn("hit", F.when(F.col("side") == 0, F.struct("t", "own")))
    back = Window.partitionBy(*keys).orderBy("t", "side", F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t"), "side", F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)  # later rows; growing frames are summed up once
    found = rows.select("*", F.last("hit", ignorenulls=True).over(back).alias("before"), F.last("hit", ignorenulls=True).over(ahead).alias("after")).where("side = 1")
    apart = lambda h: F.abs(F.timestamp_diff("MICROSECOND", F.col("t"), F.col(h)["t"]))
    choice = lambda h: F.when(F.col(h).isNotNull(), F.struct(apart(h).alias("apart_us"), F.col(h)["t"].alias("t"), F.col(h)["own"].alias("own")))
    found = found.withColumn("best", F.least(choice("before"), choice("after"))).where("best IS NOT NULL")
    return found.select("row.*", F.col("best.t").alias(right_time), F.col("best.own").alias(tie), F.col("best.apart_us").alias("apart_us"))


def truncate_at(points: DataFrame, first_times: DataFrame, key: str = "sid", time: str = "iso_time", limit: str = "first_time") -> DataFrame:
    """Points up to each entity's first event; entities without one keep all."""
    return points.join(first_times, key, "left").where(F.col(limit).isNull() | (F.col(time) <= F.col(limit)))


def compare_tables(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Full outer comparison: where rows are, and whether values agree within tolerance."""
    a = new.select(*keys, *[F.col(c).alias(f"{c}_new") for c in columns], F.lit(True).alias("__a"))
    b = old.select(*keys, *[F.col(c).alias(f"{c}_old") for c in columns], F.lit(True).alias("__b"))
    out = a.join(b, keys, "full_outer")
    where = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("both")

    def close(c: str) -> Column:
        x, y = F.col(f"{c}_new"), F.col(f"{c}_old")
        return F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), x.isNull() & y.isNull())

    return out.select(*keys, where.alias("found_in"), *[close(c).alias(f"{c}_close") for c in columns])


def paired_contrast(df: DataFrame, identity: list[str], factor: str, a: str, b: str, value: str) -> DataFrame:
    """value(b) - value(a) over rows that agree on everything but the factor."""
    side = lambda level, name: df.where(F.col(factor) == level).select(*identity, F.col(value).alias(name))
    return side(a, "value_a").join(side(b, "value_b"), identity).withColumn("shift", F.col("value_b") - F.col("value_a"))


CROWD, FINEST = 16, 8  # positions that a bin should hold at most; how often bins are cut by four for that


def nearest_cell_join(points: DataFrame, cells: DataFrame, point_id: str, max_km: float, width: float, itself: bool = True) -> DataFrame:
    """Each point with the nearest cell within max_km, by bins of twice ``width``, which is at least as wide as the radius.

    Without ``itself``, a point is not matched to the cell of its own id.
    A position holds its cells of the two smallest ids, whatever it has.  A point looks into the four bins around it; what
    is nearer than half a bin is seen.  Bins are first so fine that the fullest holds few positions; points whose
    nearest cell may lie beyond them look again in bins four times as wide, so crowded places cost no pairs.  Longitudes wrap.
    """
    others = [c for c in cells.columns if c not in ("cell_id", "cell_lat", "cell_lon")]
    axes = lambda lat, lon: F.array(F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    own = cells.groupBy("cell_lat", "cell_lon", "cell_id").agg(F.min(F.struct(*others)).alias("__o")) if others else cells.select("cell_lat", "cell_lon", "cell_id").distinct()
    first = Window.partitionBy("cell_lat", "cell_lon").orderBy("cell_id")
    two = own.withColumn("__r", F.row_number().over(first)).where("__r <= 2").groupBy("cell_lat", "cell_lon").agg(F.array_sort(F.collect_list(F.struct("cell_id", *(["__o"] if others else [])))).alias("__two"))
    spots = cut(two)
    bins = lambda lat, lon, w: (F.floor(F.col(lat) / w), F.pmod(F.floor(F.col(lon) / w), F.lit(int(360 // w))))

    def crowded(w: float) -> bool:
        by, bx = bins("cell_lat", "cell_lon", w)
        return (spots.groupBy(by.alias("by"), bx.alias("bx")).count().agg(F.max("count")).first()[0] or 0) > CROWD

    widths = [2 * width]
    while len(widths) <= FINEST and crowded(widths[-1]):
        widths.append(widths[-1] / 4)
    reach = (2 * math.sin(min(max_km / EARTH_KM, math.pi) / 2)) ** 2
    pending, done = points, []
    for w in reversed(widths):
        by, bx = bins("cell_lat", "cell_lon", w)
        near = spots.select("cell_lat", "cell_lon", "__two", by.alias("by"), bx.alias("bx"))
        sides = [F.array(F.floor(x), F.floor(x) + F.when(x - F.floor(x) < 0.5, -1).otherwise(1)) for x in (F.col("lat") / w, F.col("lon") / w)]
        at = pending.withColumn("by", F.explode(sides[0])).withColumn("bx", F.explode(sides[1])).withColumn("bx", F.pmod("bx", F.lit(int(360 // w))))
        out = at.join(near, ["by", "bx"])
        out = out.withColumn("__c", F.get("__two", F.lit(0)) if itself else F.get(F.filter("__two", lambda c: c["cell_id"] != F.col(point_id)), F.lit(0))).where("__c IS NOT NULL")
        out = out.withColumn("__d", F.zip_with(axes("lat", "lon"), axes("cell_lat", "cell_lon"), lambda x, y: (x - y) * (x - y))).where(F.aggregate("__d", F.lit(0.0), lambda t, x: t + x) <= reach * (1 + 1e-9) + 1e-14)
        out = out.withColumn("match_km", great_circle_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))).where(F.col("match_km") <= max_km)
        if w != widths[0]:
            seen = F.asin(F.cos(F.radians("lat")) * math.sin(math.radians(w / 2))) * EARTH_KM
            out = out.where(F.col("match_km") <= seen * (1 - 1e-7))
        best = out.groupBy(point_id).agg(F.min(F.struct("match_km", F.col("__c.cell_id").alias("cell_id"), "cell_lat", "cell_lon", *[F.col(f"__c.__o.{c}").alias(c) for c in others])).alias("__m"), F.any_value(F.struct(*[c for c in points.columns if c != point_id])).alias("__p"))
        best = best.select(point_id, "__p.*", "__m.cell_id", *[F.col(f"__m.{c}") for c in cells.columns if c != "cell_id"], "__m.match_km")
        if w != widths[0]:
            best = cut(best)
            pending = cut(pending.join(best.select(point_id), point_id, "left_anti"))
        done.append(best)
    return reduce(DataFrame.unionAll, done)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: each row's place, from 0, in the order of ``order``, which should tell rows apart.

    Rows are sorted across tasks and counted by task; a row's place is that in its task behind what all earlier
    tasks hold.  The sorted rows are written, so that both steps see the same.
    """
    rows = cut(df.orderBy(*order).select("*", F.spark_partition_id().alias("__task"), (F.monotonically_increasing_id() % F.lit(2**33)).alias("__at")))
    counts = rows.groupBy("__task").agg(F.count("*").alias("__n"))
    ahead = counts.select("__task", F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    return rows.join(F.broadcast(ahead), "__task").select(*df.columns, (F.col("__ahead") + F.col("__at")).alias(out))  # a row a task


def dense_keys(df: DataFrame, keys: list[str], out: str = "key_id") -> DataFrame:
    """Distinct keys numbered from 0 in their order."""
    return numbered(df.select(*keys).distinct(), keys, out)
