"""Named queries of the chain from screened candidates to exact crossings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import coast, tracks
from ..sources.adapters import tracks as smooth
from .registry import COAST, TRK, query, seg

#: Two islands: a triangle, and a square with a lake.
RINGS = [
    (0, 120.0, 10.0, 140.0, 12.0), (0, 140.0, 12.0, 128.0, 25.0), (0, 128.0, 25.0, 120.0, 10.0), (1, 150.0, 15.0, 160.0, 15.0), (1, 160.0, 15.0, 160.0, 30.0), (1, 160.0, 30.0, 150.0, 30.0),
    (1, 150.0, 30.0, 150.0, 15.0), (1, 152.0, 18.0, 152.0, 24.0), (1, 152.0, 24.0, 156.0, 24.0), (1, 156.0, 24.0, 156.0, 18.0), (1, 156.0, 18.0, 152.0, 18.0),
]
SCREEN = "(lon BETWEEN 149.5 AND 160.5 AND lat BETWEEN 14.5 AND 30.5 AND NOT (lon BETWEEN 153 AND 155 AND lat BETWEEN 19 AND 23)) OR (lon BETWEEN 119 AND 141 AND lat BETWEEN 9 AND 26)"
OWNED = "pts AS (SELECT *, list_extract(['USA','TOKYO','CMA'], (sid % 3 + 1)::INT) AS agency FROM trk)"
CANDIDATES = f"""stp AS (SELECT sid, agency, event_id, iso_time, dt_h, n, k, lat + k / n * (lat2 - lat) AS lat, lon + k / n * (lon2 - lon) AS lon FROM (SELECT *, unnest(range(n::INT + 1)) AS k FROM (SELECT *, greatest(1.0::DOUBLE, ceil(greatest(abs(lat2 - lat), abs(lon2 - lon)) / 0.5)) AS n FROM seg))),
scr AS (SELECT *, ({SCREEN}) AS land FROM stp), chg AS (SELECT *, lag(land) OVER (PARTITION BY sid, event_id ORDER BY k) AS was FROM scr),
cnd AS (SELECT event_id AS probe_id, agency, sid, iso_time + to_microseconds(round_even(k / n * dt_h * 3.6e9, 0)::BIGINT) AS time, k / n AS share, lat, lon FROM chg WHERE land AND NOT was QUALIFY row_number() OVER (PARTITION BY sid, event_id ORDER BY k) = 1)"""
EXACT = f"""edg AS (SELECT * FROM (VALUES {", ".join(map(str, RINGS))}) e(polygon_id, x1, y1, x2, y2)), brk AS (SELECT c.probe_id, c.time, s.* FROM cnd c JOIN seg s ON s.sid = c.sid AND c.time BETWEEN s.iso_time AND s.iso_time2 QUALIFY row_number() OVER (PARTITION BY c.probe_id ORDER BY s.iso_time, s.iso_time2) = 1),
use AS (SELECT DISTINCT event_id, lat, lon, lat2, lon2 FROM brk), vec AS (SELECT *, lon2 - lon AS dx, lat2 - lat AS dy, (x2 - x1)::DOUBLE AS ex, (y2 - y1)::DOUBLE AS ey, (x1 - lon)::DOUBLE AS ox, (y1 - lat)::DOUBLE AS oy FROM use, edg),
met AS (SELECT event_id, lat, lon, lat2, lon2, (ox * ey - oy * ex) / (dx * ey - dy * ex) AS f, (ox * dy - oy * dx) / (dx * ey - dy * ex) AS g FROM vec WHERE dx * ey - dy * ex <> 0),
unq AS (SELECT event_id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(lat2) AS lat2, any_value(lon2) AS lon2, min(f) AS f FROM met WHERE f BETWEEN 0 AND 1 AND g BETWEEN 0 AND 1 GROUP BY event_id, round(f, 7)),
bnd AS (SELECT *, lag(f, 1, 0.0::DOUBLE) OVER w AS a, f AS z FROM unq WINDOW w AS (PARTITION BY event_id ORDER BY f) UNION ALL SELECT event_id, lat, lon, lat2, lon2, f, f AS a, 1.0::DOUBLE AS z FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY f DESC) AS r FROM unq) WHERE r = 1),
mid AS (SELECT event_id, a, z, lon + m * (lon2 - lon) AS px, lat + m * (lat2 - lat) AS py FROM (SELECT *, CASE WHEN z - a > 1e-10 THEN (a + z) / 2 ELSE least(1.0, a + 1e-8) END AS m FROM bnd)),
pip AS (SELECT event_id, a, z, polygon_id, sum(((y1 <= py) <> (y2 <= py) AND px < x1 + (py - y1) * (x2 - x1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END))::INT) % 2 = 1 AS inside FROM mid, edg GROUP BY ALL),
sta AS (SELECT event_id, a, z, bool_or(inside) AS land FROM pip GROUP BY ALL), ent AS (SELECT event_id, z AS f FROM (SELECT *, lead(land) OVER (PARTITION BY event_id ORDER BY a, z) AS nxt FROM sta) WHERE NOT land AND nxt),
hit AS (SELECT probe_id, arg_min(f, (abs(f - (epoch_us(time) - epoch_us(iso_time)) / (dt_h * 3.6e9)), f)) AS f FROM brk JOIN ent USING (event_id) GROUP BY probe_id),
evt AS (SELECT DISTINCT agency, sid, iso_time + to_microseconds(round_even(f * (epoch_us(iso_time2) - epoch_us(iso_time)), 0)::BIGINT) AS time, lat + f * (lat2 - lat) AS lat, lon + f * (lon2 - lon) AS lon, wind + f * (wind2 - wind) AS wind, iso_time AS segment_start, iso_time2 AS segment_end, f AS segment_fraction FROM brk JOIN hit USING (probe_id)),
ord AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY time) AS r FROM evt),
kep AS (SELECT *, time AS last, true AS kept FROM ord WHERE r = 1 UNION ALL SELECT o.*, CASE WHEN o.time - k.last >= INTERVAL 12 HOUR THEN o.time ELSE k.last END, o.time - k.last >= INTERVAL 12 HOUR FROM kep k JOIN ord o ON o.sid = k.sid AND o.r = k.r + 1),
exc AS (SELECT * FROM kep WHERE kept)"""
CHAIN = f"WITH RECURSIVE {TRK}, {OWNED}, {seg('pts').replace('lead(lon) OVER w AS lon2', 'lead(lon) OVER w AS lon2, lead(wind) OVER w AS wind2')}, {CANDIDATES}, {EXACT}"


def chain(spark, d):
    """Points, screened candidates, exact events and unresolved candidates."""
    p = smooth(spark, d).withColumn("agency", F.element_at(F.array(F.lit("USA"), F.lit("TOKYO"), F.lit("CMA")), (F.col("sid") % 3 + 1).cast("int")))
    land = F.expr(SCREEN.replace("lat ", "dlat ").replace("lon ", "dlon "))
    steps = tracks.crossings(tracks.segments(p), land, 0.5)
    found = steps.select(F.col("event_id").alias("probe_id"), "agency", "sid", F.timestamp_add("MICROSECOND", F.rint(F.col("f") * F.col("dt_h") * 3.6e9).cast("long"), F.col("iso_time")).alias("time"), F.col("dlat").alias("lat"), F.col("dlon").alias("lon"))
    edges = spark.createDataFrame(RINGS, "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    events, unresolved = coast.refine_crossings(found, p, edges, geo.classify_boxes(F.col("lat"), F.col("lon")))
    return p, found, events, unresolved


@query("exact_crossings", f"{CHAIN} SELECT agency, sid, date_trunc('second', time) AS time, round(lat, 5) AS lat, round(lon, 5) AS lon, round(wind, 4) AS wind, {COAST} AS coast, round(segment_fraction, 6) AS segment_fraction FROM exc")
def exact_crossings(spark, d):
    events = chain(spark, d)[2]
    return events.select("agency", "sid", F.date_trunc("second", "time").cast("timestamp_ntz").alias("time"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("wind", 4).alias("wind"), "coast", F.round("segment_fraction", 6).alias("segment_fraction"))


@query("crossing_rules", f"""{CHAIN}, st AS (SELECT sid, iso_time, wind >= 34 AND event_id % 4 <> 0 AS native FROM pts QUALIFY row_number() OVER (PARTITION BY sid, iso_time ORDER BY event_id DESC) = 1),
r AS (SELECT x.agency, CASE WHEN x.lon >= 145 THEN 'East' ELSE 'West' END AS coast, a.native AS s, b.native AS e FROM exc x JOIN st a ON a.sid = x.sid AND a.iso_time = x.segment_start JOIN st b ON b.sid = x.sid AND b.iso_time = x.segment_end)
SELECT agency, coast, count(*) AS n, count(*) FILTER (s) AS pre_crossing, count(*) FILTER (s OR e) AS either_end, count(*) FILTER (s AND e) AS both_ends FROM r GROUP BY ALL""")
def crossing_rules(spark, d):
    p, _, events, _ = chain(spark, d)
    states = tracks.keep_last(p, ["agency", "sid", "iso_time"], "event_id").select("agency", "sid", "iso_time", ((F.col("wind") >= 34) & (F.col("event_id") % 4 != 0)).alias("native"))
    authority = events.select("agency", "sid", "segment_start", "segment_end", F.when(F.col("lon") >= 145, "East").otherwise("West").alias("coast_exclusive")).dropDuplicates(["agency", "sid", "segment_start", "segment_end"])
    out = coast.attach_states(events, states, authority)
    return out.groupBy("agency", "coast").agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c), 1)).alias(c) for c in ("pre_crossing", "either_end", "both_ends")])


@query("crossing_comparison", f"{CHAIN}, p AS (SELECT c.probe_id, x.lat - c.lat AS lat_apart, x.lon - c.lon AS lon_apart, abs(epoch_us(x.time) - epoch_us(c.time)) / 3.6e9::DOUBLE AS h FROM cnd c LEFT JOIN exc x ON x.sid = c.sid QUALIFY row_number() OVER (PARTITION BY c.probe_id ORDER BY abs(epoch_us(x.time) - epoch_us(c.time)) NULLS LAST, x.time) = 1) SELECT probe_id, h IS NOT NULL AS matched, round(h, 5) AS hours_apart, round(lat_apart, 5) AS lat_apart, round(lon_apart, 5) AS lon_apart FROM p")
def crossing_comparison(spark, d):
    _, found, events, _ = chain(spark, d)
    out = coast.compare_with_screen(found, events)
    return out.select("probe_id", "matched", *[F.round(c, 5).alias(c) for c in ("hours_apart", "lat_apart", "lon_apart")])


@query("crossing_audit", f"{CHAIN} SELECT agency, CASE WHEN day(time) <= 15 THEN 'early' ELSE 'late' END AS period, count(*) AS candidate_n, round(avg(lat), 6) AS candidate_mean_lat, count(*) FILTER (f IS NULL) AS unresolved_n, round(avg(lat) FILTER (f IS NULL), 6) AS unresolved_mean_lat, round(count(*) FILTER (f IS NULL) / count(*)::DOUBLE, 6) AS unresolved_fraction FROM cnd LEFT JOIN hit USING (probe_id) GROUP BY ALL")
def crossing_audit(spark, d):
    _, found, _, unresolved = chain(spark, d)
    found = found.withColumn("period", F.when(F.dayofmonth("time") <= 15, "early").otherwise("late"))
    out = coast.screen_audit(found, unresolved, ["agency", "period"])
    return out.withColumns({c: F.round(c, 6) for c in ("candidate_mean_lat", "unresolved_mean_lat", "unresolved_fraction")})
