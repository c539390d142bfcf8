"""From screened candidates to exact crossings from sea to land, and what is known of them.

Coasts are tables of edges (polygon_id, x1, y1, x2, y2); a polygon's rings, holes included, are just more of its
edges.  Longitudes may run on past 360 or below 0 on either side: edges are laid out at three turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import lon_difference
from .joins import bracket_join, nearest_time_join, safe_join
from .tracks import in_order, min_separation, segments

SAME, NARROW, NEAR = 1e-8, 1e-10, 1e-9  # fractions that are one; an interval too narrow to halve; degrees that count as on an edge


def turned(edges: DataFrame) -> DataFrame:
    """Edges at all three turns, with the box of their polygon."""
    box = edges.groupBy("polygon_id").agg(*[f(g(f"{a}1", f"{a}2")).alias(f"{a}{name}") for a in "xy" for f, g, name in ((F.min, F.least, "lo"), (F.max, F.greatest, "hi"))])
    out = edges.join(box, "polygon_id").withColumn("turn", F.explode(F.array(*[F.lit(t) for t in (-360.0, 0.0, 360.0)])))
    return out.withColumns({c: F.col(c) + F.col("turn") for c in ("x1", "x2", "xlo", "xhi")})


def meeting_places(segs: DataFrame, edges: DataFrame, keys: list[str], width: float = 5.0) -> DataFrame:
    """(keys, f): every part of a segment at which it meets an edge; of edges that run along it, the ends of what they share.

    Both are filed under the boxes of ``width`` degrees that they touch, so a segment meets near edges only.
    """
    segs = segs.select(*keys, "lat", "lon", "lat2", (F.col("lon") + lon_difference(F.col("lon"), F.col("lon2"))).alias("lon2"))
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - NEAR) / width), F.floor((F.greatest(a, b) + NEAR) / width)))
    s = segs.withColumn("bx", span("lon", "lon2")).withColumn("by", span("lat", "lat2"))
    e = edges.withColumn("bx", span("x1", "x2")).withColumn("by", span("y1", "y2"))
    near = s.join(e, ["bx", "by"])
    dx, dy, ex, ey = F.col("lon2") - F.col("lon"), F.col("lat2") - F.col("lat"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ox, oy = F.col("x1") - F.col("lon"), F.col("y1") - F.col("lat")
    cross, square = dx * ey - dy * ex, dx * dx + dy * dy
    f, g = F.try_divide(ox * ey - oy * ex, cross), F.try_divide(ox * dy - oy * dx, cross)
    along = lambda x, y: F.try_divide((F.col(x) - F.col("lon")) * dx + (F.col(y) - F.col("lat")) * dy, square)
    a, b = along("x1", "y1"), along("x2", "y2")
    low, high = F.greatest(F.lit(0.0), F.least(a, b)), F.least(F.lit(1.0), F.greatest(a, b))
    flat = (cross == 0) & (F.abs(ox * dy - oy * dx) <= NEAR) & (low <= high)
    places = F.when((cross != 0) & f.between(0, 1) & g.between(0, 1), F.array(f)).when(flat, F.array(low, high))
    return near.select(*keys, F.explode(places).alias("f")).distinct()


def on_land(places: DataFrame, edges: DataFrame, ids: list[str], band: float = 0.5) -> DataFrame:
    """(ids, land) of places (ids, px, py): inside a polygon or on its edge.

    A ray to the east meets the edges of the place's band of latitude, of polygons whose box holds the place; an
    odd number means inside.  Edges are filed by band, so a place meets only these.
    """
    row = lambda y: F.floor(F.col(y) / band)
    e = edges.withColumn("band", F.explode(F.sequence(F.floor((F.least("y1", "y2") - NEAR) / band), F.floor((F.greatest("y1", "y2") + NEAR) / band))))
    px, py = F.col("px"), F.col("py")
    near = places.withColumn("band", row("py")).join(e, "band").where(py.between(F.col("ylo") - NEAR, F.col("yhi") + NEAR) & px.between(F.col("xlo") - NEAR, F.col("xhi") + NEAR))
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    met = ((F.col("y1") <= py) != (F.col("y2") <= py)) & (px < F.col("x1") + F.try_divide((py - F.col("y1")) * ex, ey))
    close = F.abs(ex * (py - F.col("y1")) - ey * (px - F.col("x1"))) <= NEAR * F.greatest(F.lit(NEAR), F.sqrt(ex * ex + ey * ey))
    touch = close & px.between(F.least("x1", "x2") - NEAR, F.greatest("x1", "x2") + NEAR) & py.between(F.least("y1", "y2") - NEAR, F.greatest("y1", "y2") + NEAR)
    one = near.groupBy(*ids, "polygon_id", "turn").agg((F.sum(F.coalesce(met, F.lit(False)).cast("int")) % 2 == 1).alias("inside"), F.max(touch).alias("edge"))
    land = one.groupBy(*ids).agg(F.max(F.col("inside") | F.col("edge")).alias("__land"))
    return places.select(*ids).join(land, ids, "left").select(*ids, F.coalesce("__land", F.lit(False)).alias("land"))


def entry_fractions(segs: DataFrame, edges: DataFrame, keys: list[str], width: float = 5.0, band: float = 0.5) -> DataFrame:
    """(keys, f): the parts of each segment at which it goes from sea to land.

    Meeting places that differ by no more than 1e-8 are one.  Between them, and before and behind, the state is
    that of the middle.
    """
    edges = turned(edges)
    found = meeting_places(segs, edges, keys, width).groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("all"))
    empty = F.array().cast("array<double>")
    apart = F.aggregate("all", empty, lambda t, x: F.when((F.size(t) == 0) | (x - F.element_at(t, -1) > SAME), F.concat(t, F.array(x))).otherwise(t))
    bounds = found.select(*keys, apart.alias("f")).withColumn("b", F.concat(F.array(F.lit(0.0)), "f", F.array(F.lit(1.0))))
    middle = lambda a, b: F.when(b - a > NARROW, (a + b) / 2).otherwise(F.least(F.lit(1.0), a + SAME))
    parts = bounds.select(*keys, F.posexplode(F.transform(F.slice("b", 1, F.size("b") - 1), lambda a, i: F.struct(a.alias("a"), F.get("b", i + 1).alias("z")))).alias("i", "p"))
    at = middle(F.col("p.a"), F.col("p.z"))
    places = parts.join(segs.select(*keys, "lat", "lon", "lat2", (F.col("lon") + lon_difference(F.col("lon"), F.col("lon2"))).alias("lon2")), keys)
    places = places.select(*keys, "i", F.col("p.z").alias("z"), (F.col("lon") + at * (F.col("lon2") - F.col("lon"))).alias("px"), (F.col("lat") + at * (F.col("lat2") - F.col("lat"))).alias("py"))
    state = places.select(*keys, "i", "z").join(on_land(places.select(*keys, "i", "px", "py"), edges, [*keys, "i"], band), [*keys, "i"])
    w = Window.partitionBy(*keys).orderBy("i")
    return state.withColumn("next", F.lead("land").over(w)).where("NOT land AND next").select(*keys, F.col("z").alias("f"))


def refine_crossings(candidates: DataFrame, points: DataFrame, edges: DataFrame, coast: Column, max_gap_hours: float = 12.0, hours_apart: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """Exact events and unresolved candidates (agency, sid, time, reason).

    candidates: (probe_id, agency, sid, time), probe_id unique; points: (agency, sid, event_id, iso_time, lat, lon,
    wind), a sid belonging to one agency; ``coast``: an expression on lat and lon.  A candidate's segment is the first
    that holds its time; its event is the entry nearest to its part of the segment, the earlier of two.  Time,
    place and wind are those of the entry, wind null where either end's is; longitudes are in [0, 360).  Events of
    one entity less than ``hours_apart`` after the last one kept are dropped.
    """
    segs = segments(points.withColumn("wind2", F.lead("wind").over(in_order())), max_gap_hours)
    segs = segs.select("agency", "sid", "event_id", "iso_time", "iso_time2", "lat", "lon", "lat2", "lon2", "wind", "wind2")
    known = segs.select("agency", "sid").distinct().withColumn("known", F.lit(True))
    asked = candidates.select("probe_id", "agency", "sid", "time").join(known, ["agency", "sid"], "left")
    held = bracket_join(asked, segs, ["agency", "sid"], "time", "iso_time", "iso_time2")
    used = held.select(*segs.columns).distinct()
    entries = entry_fractions(used, edges, ["agency", "sid", "event_id"])
    length = F.timestamp_diff("MICROSECOND", F.col("iso_time"), F.col("iso_time2"))
    share = F.timestamp_diff("MICROSECOND", F.col("iso_time"), F.col("time")) / length
    best = held.join(entries, ["agency", "sid", "event_id"]).groupBy("probe_id").agg(F.min_by("f", F.struct(F.abs(F.col("f") - share).alias("d"), "f")).alias("f"))
    out = asked.select("probe_id", "agency", "sid", "time", "known").join(held.drop("agency", "sid", "time", "known"), "probe_id", "left").join(best, "probe_id", "left")
    reason = F.when(F.col("known").isNull(), "sid_not_in_track_segments").when(F.col("event_id").isNull(), "candidate_not_bracketed").when(F.col("f").isNull(), "no_exact_sea_to_land_intersection")
    out = out.withColumn("reason", reason)
    f = F.col("f")
    lerp = lambda a, b: F.col(a) + f * (b - F.col(a))
    events = out.where("reason IS NULL").select(
        "agency", "sid", F.timestamp_add("MICROSECOND", F.rint(f * length).cast("long"), F.col("iso_time")).alias("time"), lerp("lat", F.col("lat2")).alias("lat"),
        F.pmod(lerp("lon", F.col("lon") + lon_difference(F.col("lon"), F.col("lon2"))), F.lit(360.0)).alias("lon"), lerp("wind", F.col("wind2")).alias("wind"),
        F.col("iso_time").alias("segment_start"), F.col("iso_time2").alias("segment_end"), f.alias("segment_fraction"),
    )
    events = events.dropDuplicates(["agency", "sid", "time"]).withColumn("coast", coast)
    stamp = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("time"))
    kept = min_separation(events.withColumn("iso_time", F.col("time")).withColumn("event_id", stamp), hours_apart, ("agency", "sid"))
    return kept.drop("iso_time", "event_id"), out.where("reason IS NOT NULL").select("agency", "sid", "time", "reason")


def attach_states(events: DataFrame, states: DataFrame, authority: DataFrame) -> DataFrame:
    """Events with the stage at both ends of their segment, the rules that follow, and their exclusive coast.

    states: (agency, sid, iso_time, native), one a time; authority: (agency, sid, segment_start, segment_end,
    coast_exclusive), one a segment.  An event without any of these is an error.
    """
    keys = ["agency", "sid", "segment_start", "segment_end"]
    out = safe_join(events, authority, keys, "left", "many_to_one")
    for side in ("start", "end"):
        own = states.select("agency", "sid", F.col("iso_time").alias(f"segment_{side}"), F.col("native").alias(f"{side}_native"))
        out = safe_join(out, own, ["agency", "sid", f"segment_{side}"], "left", "many_to_one")
    if not out.where("coast_exclusive IS NULL OR start_native IS NULL OR end_native IS NULL").isEmpty():
        raise ValueError("an event lacks its coast or the state at an end of its segment")
    rules = {"pre_crossing": F.col("start_native"), "either_end": F.col("start_native") | F.col("end_native"), "both_ends": F.col("start_native") & F.col("end_native")}
    return out.withColumns(rules).withColumn("coast_screened", F.col("coast")).withColumn("coast", F.col("coast_exclusive")).drop("coast_exclusive")


def compare_with_screen(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Each candidate (probe_id, agency, sid, time, lat, lon) with the event of its entity that is nearest in time: matched, hours, lat and lon apart."""
    stamp = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("time"))
    exact = events.select("agency", "sid", F.col("time").alias("exact_time"), stamp.alias("tie"), F.col("lat").alias("exact_lat"), F.col("lon").alias("exact_lon"))
    near = nearest_time_join(candidates.select("agency", "sid", "probe_id", "time"), exact.select("agency", "sid", "exact_time", "tie"), ["agency", "sid"], "probe_id", "time", "exact_time", "tie")
    near = near.select("probe_id", "agency", "sid", "exact_time", (F.col("apart_us") / 3.6e9).alias("hours_apart")).join(exact.drop("tie"), ["agency", "sid", "exact_time"])
    out = candidates.select("probe_id", "agency", "sid", "lat", "lon").join(near.drop("agency", "sid"), "probe_id", "left")
    return out.select("probe_id", "agency", "sid", F.col("exact_time").isNotNull().alias("matched"), "hours_apart", (F.col("exact_lat") - F.col("lat")).alias("lat_apart"), (F.col("exact_lon") - F.col("lon")).alias("lon_apart"))


def screen_audit(candidates: DataFrame, unresolved: DataFrame, by: list[str]) -> DataFrame:
    """Per group: candidates, their mean latitude, how many are unresolved, theirs, and the fraction."""
    marks = unresolved.select("agency", "sid", "time").distinct().withColumn("open", F.lit(1))
    rows = candidates.join(marks, ["agency", "sid", "time"], "left")
    out = rows.groupBy(*by).agg(F.count("*").alias("candidate_n"), F.avg("lat").alias("candidate_mean_lat"), F.count("open").alias("unresolved_n"), F.avg(F.when(F.col("open") == 1, F.col("lat"))).alias("unresolved_mean_lat"))
    return out.withColumn("unresolved_fraction", F.col("unresolved_n") / F.col("candidate_n"))
