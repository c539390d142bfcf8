"""Named queries of the library over the standard tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import annual, contrast, density, fields, inference, joins, models, tracks
from ..sources.adapters import AGENCIES, points, table
from ..sources.adapters import tracks as smooth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EARLY, LATE = (1, 15), (16, 31)
THRESHOLD, SUPER = 34.0, 130.0

# Common tables of the SQL side.
PTS = """pts AS (SELECT user_id AS sid, event_id, ts AS iso_time, day(ts) AS season, list_extract(['USA','TOKYO','CMA'], (event_id % 3 + 1)::INT) AS agency,
  event_type AS nature, value AS wind, ((event_id * 7919 + c) % 4000) / 100.0::DOUBLE AS lat, 100.0::DOUBLE + ((event_id * 104729 + 31 * c) % 8000) / 100.0::DOUBLE AS lon
  FROM (SELECT *, round(value * 100)::BIGINT AS c FROM events))"""
TRK = """trk AS (SELECT user_id AS sid, event_id, ts AS iso_time, value AS wind, 2.0::DOUBLE + 1.3::DOUBLE * h + user_id % 4 AS lat, 130.0::DOUBLE + 2.0::DOUBLE * abs(h - 15) + user_id % 20 AS lon
  FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 8.64e10::DOUBLE AS h FROM events))"""


def dist(a: str, b: str, c: str, d: str) -> str:
    return f"2*6371.0::DOUBLE*asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))"


def seg(source: str) -> str:
    return f"""nxt AS (SELECT *, lead(iso_time) OVER w AS iso_time2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {source} WINDOW w AS (PARTITION BY sid ORDER BY iso_time, event_id)),
  gap AS (SELECT *, (epoch_us(iso_time2) - epoch_us(iso_time)) / 3.6e9::DOUBLE AS dt_h FROM nxt),
  seg AS (SELECT *, {dist("lat", "lon", "lat2", "lon2")} AS dist_km FROM gap WHERE dt_h > 0 AND dt_h <= 12)"""


def cell(lat: str = "lat", lon: str = "lon") -> str:
    return f"((CASE WHEN {lat} = 40 THEN 7 ELSE floor({lat} / 5) END) * 16 + (CASE WHEN {lon} = 180 THEN 15 ELSE floor(({lon} - 100) / 5) END))::INT"


INSIDE = "lat BETWEEN 0 AND 40 AND lon BETWEEN 100 AND 180"
COAST = "CASE " + " ".join(f"WHEN lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} THEN '{name}'" for name, w, e, s, n in geo.COASTS) + " ELSE 'Other' END"
CELLS = f"cells AS (SELECT *, {cell()} AS cell_id FROM pts WHERE {INSIDE})"
SHARES = f"{CELLS}, shares AS (SELECT season, cell_id, count(*) / sum(count(*)) OVER (PARTITION BY season)::DOUBLE AS share FROM cells GROUP BY season, cell_id)"
MEANS = f"""{SHARES}, ny AS (SELECT count(DISTINCT season) FILTER (season <= 15) AS ne, count(DISTINCT season) FILTER (season > 15) AS nl FROM shares),
  means AS (SELECT cell_id, coalesce(sum(share) FILTER (season <= 15), 0) / any_value(ne) AS early, coalesce(sum(share) FILTER (season > 15), 0) / any_value(nl) AS late FROM shares, ny GROUP BY cell_id)"""


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def coast_points(spark, d):
    return points(spark, d).withColumn("coast", geo.classify_boxes(F.col("lat"), F.col("lon")))


def seasons(spark, d):
    return points(spark, d).select("season").distinct()


def daily(spark, d):
    """A yearly series: mean latitude and mean wind by season."""
    return points(spark, d).groupBy("season").agg(F.avg("lat").alias("lat"), F.avg("wind").alias("wind"))


DAILY = "daily AS (SELECT season, avg(lat) AS lat, avg(wind) AS wind FROM pts GROUP BY season)"


@query("points_typed", f"WITH {PTS} SELECT sid, event_id, season, agency, round(lat, 6) AS lat, round((lon - 360 + 720) % 360, 6) AS lon, hour(iso_time)::INT AS hour FROM pts WHERE hour(iso_time) IN (0, 6, 12, 18) AND wind BETWEEN 1 AND 400")
def points_typed(spark, d):
    p = points(spark, d).where(F.hour("iso_time").isin(0, 6, 12, 18) & F.col("wind").between(1, 400))
    return r6(p.select("sid", "event_id", "season", "agency", "lat", geo.wrap_lon(F.col("lon") - 360).alias("lon"), F.hour("iso_time").alias("hour")), "lat", "lon")


@query("entity_eligible", f"WITH {PTS} SELECT sid, count(*) AS n FROM pts WHERE sid IN (SELECT sid FROM pts WHERE wind >= 34 AND (nature IS NULL OR nature = 'view') GROUP BY sid HAVING max(wind) >= 130) GROUP BY sid")
def entity_eligible(spark, d):
    p = points(spark, d)
    good = p.where(geo.tropical_stage(F.col("wind"), F.col("nature"), THRESHOLD, "view")).groupBy("sid").agg(F.max("wind").alias("m")).where(F.col("m") >= SUPER)
    return p.join(good, "sid", "left_semi").groupBy("sid").agg(F.count("*").alias("n"))


@query("entity_summary", f"""WITH {PTS}, g AS (SELECT *, (epoch_us(iso_time) - epoch_us(lag(iso_time) OVER (PARTITION BY sid ORDER BY iso_time, event_id))) / 3.6e9::DOUBLE AS gap,
  row_number() OVER (PARTITION BY sid ORDER BY wind < 34, iso_time, event_id) AS rg, row_number() OVER (PARTITION BY sid ORDER BY wind DESC, iso_time, event_id) AS rt FROM pts)
SELECT sid, max(iso_time) FILTER (rg = 1 AND wind >= 34) AS genesis_time, round(max(lat) FILTER (rg = 1 AND wind >= 34), 6) AS genesis_lat, round(max(lon) FILTER (rg = 1 AND wind >= 34), 6) AS genesis_lon, max(wind) AS lmi,
  max(iso_time) FILTER (rt = 1) AS lmi_time, round(max(lat) FILTER (rt = 1), 6) AS lmi_lat, round(sum(wind * wind) FILTER (wind >= 34) * 1e-4::DOUBLE, 4) AS ace, (max(wind) >= 130)::INT AS is_super,
  round(max(gap), 6) AS max_gap_h, count(*) AS n_points, round(avg((wind IS NOT NULL)::INT), 6) AS valid_frac FROM g GROUP BY sid""")
def entity_summary(spark, d):
    out = tracks.entity_summary(points(spark, d), THRESHOLD, SUPER).withColumn("ace", F.round("ace", 4))
    return r6(out, "genesis_lat", "genesis_lon", "lmi_lat", "max_gap_h", "valid_frac")


@query("segments", f"WITH {PTS}, {seg('pts')} SELECT sid, event_id, round(dt_h, 6) AS dt_h, round(dist_km, 5) AS dist_km, round((lat2 - lat) * 6371.0::DOUBLE * radians(1) / dt_h, 5) AS v_kmh, round((((lon2 - lon + 180) + 360) % 360 - 180) * 6371.0::DOUBLE * radians(1) * cos(radians((lat + lat2) / 2)) / dt_h, 5) AS u_kmh FROM seg")
def segments(spark, d):
    s = tracks.segments(points(spark, d)).select("sid", "event_id", "dt_h", "dist_km", "v_kmh", "u_kmh")
    return r6(s, "dt_h").withColumns({c: F.round(c, 5) for c in ("dist_km", "v_kmh", "u_kmh")})


@query("translation_speed", f"WITH {TRK}, {seg('trk')} SELECT sid, round(sum(dist_km) / sum(dt_h), 6) AS trans_speed, round(sum(dist_km), 5) AS path_km, count(*) AS n_segments FROM seg GROUP BY sid")
def translation_speed(spark, d):
    return r6(tracks.mean_speed(smooth(spark, d)), "trans_speed").withColumn("path_km", F.round("path_km", 5))


UNWRAP = "w0 AS (SELECT *, lon - lag(lon) OVER (PARTITION BY sid ORDER BY iso_time, event_id) AS dl FROM trk), w1 AS (SELECT *, lon + sum(CASE WHEN dl > 180 THEN -360.0::DOUBLE WHEN dl < -180 THEN 360.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY sid ORDER BY iso_time, event_id ROWS UNBOUNDED PRECEDING) AS ulon FROM w0)"


@query("turning_points", f"""WITH {TRK}, {UNWRAP}, s AS (SELECT *, avg(lat) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS slat, avg(ulon) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS slon,
  row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sid) AS n FROM w1 WINDOW w AS (PARTITION BY sid ORDER BY iso_time, event_id)),
a AS (SELECT *, min(slon) OVER (w ROWS UNBOUNDED PRECEDING) AS west, lead(iso_time, 4) OVER w AS ta, lead(slat, 4) OVER w AS la, lead(slon, 4) OVER w AS oa FROM s WINDOW w AS (PARTITION BY sid ORDER BY iso_time, event_id))
SELECT sid, iso_time AS turn_time, round(slat, 6) AS turn_lat, round(slon, 6) AS turn_lon FROM a
WHERE n >= 6 AND i >= 1 AND i < n - 4 AND slat >= 20 AND (epoch_us(ta) - epoch_us(iso_time)) / 3.6e9::DOUBLE >= 24 AND slon <= west + 0.5 AND oa - slon >= 2 AND la - slat >= 2
QUALIFY row_number() OVER (PARTITION BY sid ORDER BY i) = 1""")
def turning_points(spark, d):
    return r6(tracks.turning_points(smooth(spark, d)), "turn_lat", "turn_lon")


@query("min_separation", f"""WITH RECURSIVE {PTS}, o AS (SELECT sid, event_id, iso_time, row_number() OVER (PARTITION BY sid ORDER BY iso_time, event_id) AS r FROM pts),
k AS (SELECT sid, event_id, iso_time AS kept_at, r, true AS kept FROM o WHERE r = 1
  UNION ALL SELECT o.sid, o.event_id, CASE WHEN o.iso_time - k.kept_at >= INTERVAL 12 HOUR THEN o.iso_time ELSE k.kept_at END, o.r, o.iso_time - k.kept_at >= INTERVAL 12 HOUR FROM k JOIN o ON o.sid = k.sid AND o.r = k.r + 1)
SELECT sid, event_id FROM k WHERE kept""")
def min_separation(spark, d):
    return tracks.min_separation(points(spark, d)).select("sid", "event_id")


@query("resample_path", f"""WITH {TRK}, {UNWRAP}, t AS (SELECT *, (epoch_us(iso_time) - epoch_us(min(iso_time) OVER (PARTITION BY sid))) / 3.6e9::DOUBLE AS h, count(*) OVER (PARTITION BY sid) AS n_pts FROM w1),
l AS (SELECT *, max(h) OVER (PARTITION BY sid) AS life, lead(h) OVER w AS h2, lead(lat) OVER w AS lat2, lead(ulon) OVER w AS ulon2 FROM t WINDOW w AS (PARTITION BY sid ORDER BY iso_time, event_id)),
k AS (SELECT *, unnest(range(20)) AS k FROM (SELECT DISTINCT sid, life FROM l WHERE n_pts >= 4 AND life > 0)),
hit AS (SELECT l.sid, k.k::INT AS k, (k.k * l.life / 19 - h) / (h2 - h) AS f, lat, lat2, ulon, ulon2, row_number() OVER (PARTITION BY l.sid, k.k ORDER BY h DESC) AS r FROM l JOIN k ON l.sid = k.sid AND h2 > h AND h <= k.k * l.life / 19 + 1e-7 AND (k.k * l.life / 19 <= h2 + 1e-7))
SELECT sid, k, round(lat + f * (lat2 - lat), 4) AS lat, round(ulon + f * (ulon2 - ulon), 4) AS lon FROM hit WHERE r = 1""")
def resample_path(spark, d):
    out = tracks.resample(smooth(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("lat", "lon")})


@query("sea_to_land", f"""WITH {TRK}, {seg('trk')}, n AS (SELECT *, greatest(1, ceil(greatest(abs(lat2 - lat), abs(lon2 - lon)) / 0.05::DOUBLE))::INT AS n FROM seg), s AS (SELECT *, unnest(range(n + 1)) AS k FROM n),
p AS (SELECT *, lon + k / n::DOUBLE * (lon2 - lon) AS dlon FROM s), f AS (SELECT *, floor(dlon / 4) % 2 = 0 AS land FROM p), g AS (SELECT *, lag(land) OVER (PARTITION BY sid, event_id ORDER BY k) AS was FROM f)
SELECT sid, event_id, round(dlon, 5) AS lon FROM g WHERE land AND NOT was QUALIFY row_number() OVER (PARTITION BY sid, event_id ORDER BY k) = 1""")
def sea_to_land(spark, d):
    found = tracks.crossings(tracks.segments(smooth(spark, d)), F.floor(F.col("dlon") / 4) % 2 == 0, 0.05)
    return found.select("sid", "event_id", F.round("dlon", 5).alias("lon"))


@query("keep_last", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def keep_last(spark, d):
    return tracks.keep_last(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("first_named", f"WITH {PTS}, c AS (SELECT *, {COAST} AS coast FROM pts) SELECT agency, sid, event_id, coast FROM c QUALIFY row_number() OVER (PARTITION BY agency, sid ORDER BY coast = 'Other', iso_time, event_id) = 1")
def first_named(spark, d):
    return tracks.first_by(coast_points(spark, d), ["agency", "sid"], [F.col("coast") == "Other", F.col("iso_time"), F.col("event_id")]).select("agency", "sid", "event_id", "coast")


@query("strongest", f"WITH {PTS} SELECT agency, sid, event_id, wind FROM pts WHERE wind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agency, sid ORDER BY wind DESC, iso_time, event_id) = 1")
def strongest(spark, d):
    return tracks.first_by(points(spark, d).where("wind IS NOT NULL"), ["agency", "sid"], [F.desc("wind"), F.col("iso_time"), F.col("event_id")]).select("agency", "sid", "event_id", "wind")


@query("coast_counts", f"WITH {PTS} SELECT {COAST} AS coast, CASE WHEN wind >= 100 THEN 'El_Nino' WHEN wind <= -100 THEN 'La_Nina' ELSE 'Neutral' END AS phase, count(*) AS n, round(avg(wind), 6) AS mean_wind FROM pts GROUP BY 1, 2")
def coast_counts(spark, d):
    return r6(coast_points(spark, d).groupBy("coast", geo.phase(F.col("wind"), 100.0).alias("phase")).agg(F.count("*").alias("n"), F.avg("wind").alias("mean_wind")), "mean_wind")


@query("flag_filter", "SELECT count(*) FILTER (substr(flags, 2, 1) IN ('O', 'I', 'V')) AS located, count(*) FILTER (substr(flags, 2, 1) IN ('O', 'V')) AS rated FROM (SELECT substr('OIVP', (1 + event_id % 4)::INT, 1) || substr('VPOI', (1 + event_id % 3)::INT, 1) AS flags FROM events)")
def flag_filter(spark, d):
    one = lambda text, n: F.substr(F.lit(text), (1 + F.col("event_id") % n).cast("int"), F.lit(1))
    e = table(spark, d, "events").select(F.concat(one("OIVP", 4), one("VPOI", 3)).alias("flags"))
    return e.agg(F.count(F.when(geo.flag_at(F.col("flags"), 1, "OIV"), 1)).alias("located"), F.count(F.when(geo.flag_at(F.col("flags"), 1, "OV"), 1)).alias("rated"))


@query("composition_point", f"WITH {PTS}, {SHARES} SELECT season, cell_id, round(share, 9) AS share FROM shares")
def composition_point(spark, d):
    return density.composition(points(spark, d), "point").withColumn("share", F.round("share", 9))


@query("composition_entity", f"WITH {PTS}, {CELLS}, n AS (SELECT season, sid, cell_id, count(*) / sum(count(*)) OVER (PARTITION BY season, sid)::DOUBLE AS w FROM cells GROUP BY season, sid, cell_id), m AS (SELECT season, cell_id, sum(w) AS w FROM n GROUP BY season, cell_id) SELECT season, cell_id, round(w / sum(w) OVER (PARTITION BY season), 9) AS share FROM m")
def composition_entity(spark, d):
    return density.composition(points(spark, d), "entity").withColumn("share", F.round("share", 9))


@query("composition_occupancy", f"WITH {PTS}, {CELLS}, m AS (SELECT season, cell_id, count(DISTINCT sid)::DOUBLE AS w FROM cells GROUP BY season, cell_id) SELECT season, cell_id, round(w / sum(w) OVER (PARTITION BY season), 9) AS share FROM m")
def composition_occupancy(spark, d):
    return density.composition(points(spark, d), "occupancy").withColumn("share", F.round("share", 9))


@query("composition_length", f"""WITH {TRK.replace("value AS wind", "value AS wind, day(ts) AS season")}, {seg('trk')}, n AS (SELECT *, greatest(1, ceil(dist_km / 25))::INT AS n FROM seg), s AS (SELECT *, unnest(range(n)) AS k FROM n),
p AS (SELECT season, dist_km / n AS w, lat + (k + 0.5::DOUBLE) / n * (lat2 - lat) AS mlat, lon + (k + 0.5::DOUBLE) / n * (lon2 - lon) AS mlon FROM s), m AS (SELECT season, {cell('mlat', 'mlon')} AS cell_id, sum(w) AS w FROM p WHERE mlat BETWEEN 0 AND 40 AND mlon BETWEEN 100 AND 180 GROUP BY ALL)
SELECT season, cell_id, round(w / sum(w) OVER (PARTITION BY season), 7) AS share FROM m""")
def composition_length(spark, d):
    return density.composition(smooth(spark, d).withColumn("season", F.dayofmonth("iso_time")), "length").withColumn("share", F.round("share", 7))


@query("annual_metrics", f"WITH {PTS}, y AS (SELECT unnest(range(1, 41))::INT AS season) SELECT y.season, count(p.sid) AS n_events, count(DISTINCT p.sid) AS n_entities, round(avg(lat), 6) AS mean, round(median(lat), 6) AS median, round(quantile_cont(lat, 0.25), 6) AS q25, round(quantile_cont(lat, 0.75), 6) AS q75 FROM y LEFT JOIN pts p ON p.season = y.season GROUP BY y.season")
def annual_metrics(spark, d):
    years = spark.range(1, 41).select(F.col("id").cast("int").alias("season"))
    return r6(annual.annual_metrics(points(spark, d), years, "lat"), "mean", "median", "q25", "q75")


NAMES = [c[0] for c in geo.COASTS] + ["Other"]


@query("coast_shares", f"WITH {PTS}, c AS (SELECT *, {COAST} AS coast FROM pts), k AS (SELECT unnest({NAMES}) AS coast), s AS (SELECT DISTINCT season FROM c), n AS (SELECT s.season, k.coast, count(DISTINCT c.sid) AS n FROM s CROSS JOIN k LEFT JOIN c ON c.season = s.season AND c.coast = k.coast GROUP BY 1, 2) SELECT season, coast, n, round(n / sum(n) OVER (PARTITION BY season)::DOUBLE, 9) AS share FROM n")
def coast_shares(spark, d):
    names = spark.createDataFrame([(n,) for n in NAMES], "coast string")
    return annual.category_shares(coast_points(spark, d), names, "coast", by_entity=True).withColumn("share", F.round("share", 9))


@query("north_share", f"WITH {PTS}, c AS (SELECT *, {COAST} AS coast FROM pts) SELECT season, round((count(*) FILTER (coast IN ('Japan', 'Korea', 'China_E')))::DOUBLE / nullif(count(*) FILTER (coast IN ('Japan', 'Korea', 'China_E', 'Vietnam', 'Philippines', 'China_S')), 0), 9) AS share FROM c GROUP BY season")
def north_share(spark, d):
    c = F.col("coast")
    return annual.group_share(coast_points(spark, d), c.isin("Japan", "Korea", "China_E"), c.isin("Vietnam", "Philippines", "China_S")).withColumn("share", F.round("share", 9))


@query("leave_one_coast_out", f"WITH {PTS}, c AS (SELECT *, {COAST} AS coast FROM pts), k AS (SELECT DISTINCT coast AS excluded FROM c) SELECT excluded, round(avg(lat), 6) AS mean, count(*) AS n FROM c JOIN k ON coast <> excluded GROUP BY excluded")
def leave_one_coast_out(spark, d):
    p = coast_points(spark, d)
    return r6(annual.leave_one_out(p, None, "coast", "lat"), "mean")


@query("year_weights", f"WITH {PTS}, {CELLS}, o AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY sid) AS w FROM cells), m AS (SELECT season, cell_id, sum(w) AS w FROM o GROUP BY ALL) SELECT season, cell_id, round(w / sum(w) OVER (PARTITION BY season), 9) AS weight, round(sum(w) OVER (PARTITION BY season), 6) AS effective FROM m")
def year_weights(spark, d):
    return r6(annual.year_weights(density.with_cell(points(spark, d))), "effective").withColumn("weight", F.round("weight", 9))


@query("completeness", f"WITH {PTS} SELECT agency, season, count(*) AS n_rows, count(DISTINCT sid) AS n_sid, max(iso_time) AS last_time, count(DISTINCT sid) FILTER (wind IS NOT NULL) AS n_with_wind FROM pts GROUP BY ALL")
def completeness(spark, d):
    return annual.completeness(points(spark, d))


@query("pairwise_corr", f"WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS v FROM pts GROUP BY ALL) SELECT a.agency AS first, b.agency AS second, round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 6) AS r, count(*) AS n FROM m a JOIN m b ON a.season = b.season AND a.agency < b.agency GROUP BY ALL")
def pairwise_corr(spark, d):
    m = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"))
    return r6(annual.pairwise_corr(m, "agency", ["season"], "v"), "r")


@query("bracket_join", f"""WITH {PTS}, {seg('pts')}, e AS (SELECT sid, event_id AS probe_id, iso_time + INTERVAL 90 MINUTE AS probe_at FROM pts WHERE agency = 'CMA')
SELECT e.sid, probe_id, event_id FROM e JOIN seg ON e.sid = seg.sid AND probe_at BETWEEN iso_time AND iso_time2 QUALIFY row_number() OVER (PARTITION BY e.sid, probe_id ORDER BY iso_time, iso_time2) = 1""")
def bracket_join(spark, d):
    p = points(spark, d)
    probes = p.where("agency = 'CMA'").select("sid", F.col("event_id").alias("probe_id"), (F.col("iso_time") + F.expr("INTERVAL 90 MINUTE")).alias("at"))
    return joins.bracket_join(probes, tracks.segments(p).select("sid", "event_id", "iso_time", "iso_time2"), ["sid"], "at", "iso_time", "iso_time2").select("sid", "probe_id", "event_id")


@query("nearest_time_join", f"WITH {PTS} SELECT a.sid, a.event_id AS usa_id, b.event_id AS cma_id, round(abs(epoch_us(a.iso_time) - epoch_us(b.iso_time)) / 3.6e9::DOUBLE, 6) AS apart_h FROM pts a JOIN pts b ON a.sid = b.sid AND a.agency = 'USA' AND b.agency = 'CMA' QUALIFY row_number() OVER (PARTITION BY a.sid, a.event_id ORDER BY abs(epoch_us(a.iso_time) - epoch_us(b.iso_time)), b.iso_time, b.event_id) = 1")
def nearest_time_join(spark, d):
    p = points(spark, d)
    a = p.where("agency = 'USA'").select("sid", F.col("event_id").alias("usa_id"), F.col("iso_time").alias("ta"))
    b = p.where("agency = 'CMA'").select("sid", F.col("event_id").alias("cma_id"), F.col("iso_time").alias("tb"))
    out = joins.nearest_time_join(a, b, ["sid"], "usa_id", "ta", "tb", "cma_id")
    return out.select("sid", "usa_id", "cma_id", F.round(F.col("apart_us") / 3.6e9, 6).alias("apart_h"))


@query("truncate_at_first", f"WITH {PTS}, f AS (SELECT sid, min(iso_time) AS t FROM pts WHERE wind >= 130 GROUP BY sid) SELECT pts.sid, count(*) AS n FROM pts LEFT JOIN f ON pts.sid = f.sid WHERE t IS NULL OR iso_time <= t GROUP BY pts.sid")
def truncate_at_first(spark, d):
    p = points(spark, d)
    return joins.truncate_at(p, p.where(F.col("wind") >= SUPER).groupBy("sid").agg(F.min("iso_time").alias("first_time"))).groupBy("sid").agg(F.count("*").alias("n"))


@query("compare_tables", f"WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS v FROM pts GROUP BY ALL), a AS (SELECT season, v FROM m WHERE agency = 'USA' AND season > 2), b AS (SELECT season, v + (season % 2) AS v FROM m WHERE agency = 'USA' AND season < 28) SELECT coalesce(a.season, b.season) AS season, CASE WHEN b.season IS NULL THEN 'left_only' WHEN a.season IS NULL THEN 'right_only' ELSE 'both' END AS found_in, coalesce(abs(a.v - b.v) <= 1e-12::DOUBLE + 1e-10::DOUBLE * abs(b.v), a.v IS NULL AND b.v IS NULL) AS v_close FROM a FULL JOIN b ON a.season = b.season")
def compare_tables(spark, d):
    m = points(spark, d).where("agency = 'USA'").groupBy("season").agg(F.avg("lat").alias("v"))
    return joins.compare_tables(m.where("season > 2"), m.where("season < 28").withColumn("v", F.col("v") + F.col("season") % 2), ["season"], ["v"])


@query("paired_contrast", f"WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS v FROM pts GROUP BY ALL) SELECT a.season, round(b.v - a.v, 6) AS shift FROM m a JOIN m b ON a.season = b.season AND a.agency = 'USA' AND b.agency = 'CMA'")
def paired_contrast(spark, d):
    m = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"))
    return r6(joins.paired_contrast(m, ["season"], "agency", "USA", "CMA", "v").select("season", "shift"), "shift")


@query("nearest_cell", f"WITH {PTS}, c AS (SELECT event_id AS cell_id, lat AS clat, lon AS clon FROM pts), j AS (SELECT event_id, cell_id, {dist('lat', 'lon', 'clat', 'clon')} AS km FROM pts JOIN c ON abs(lat - clat) < 1 AND abs(lon - clon) < 1.5 AND event_id <> cell_id) SELECT event_id, cell_id, round(km, 5) AS match_km FROM j WHERE km <= 75 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, cell_id) = 1")
def nearest_cell(spark, d):
    p = points(spark, d)
    cells = p.select(F.col("event_id").alias("cell_id"), F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"))
    out = joins.nearest_cell_join(p.select("event_id", "lat", "lon"), cells, "event_id", 75.0, 1.0, itself=False)
    return out.select("event_id", "cell_id", F.round("match_km", 5).alias("match_km"))


@query("dense_keys", f"WITH {PTS}, {CELLS} SELECT season, cell_id, row_number() OVER (ORDER BY season, cell_id) - 1 AS key_id FROM (SELECT DISTINCT season, cell_id FROM cells)")
def dense_keys(spark, d):
    return joins.dense_keys(density.with_cell(points(spark, d)), ["season", "cell_id"])


@query("agency_spine", f"WITH {PTS}, n AS (SELECT agency, season, count(*) AS n FROM pts WHERE wind >= 130 GROUP BY ALL) SELECT a.agency, y.season, coalesce(n, 0) AS n FROM (SELECT unnest(['USA', 'TOKYO', 'CMA']) AS agency) a CROSS JOIN (SELECT unnest(range(1, 32))::INT AS season) y LEFT JOIN n ON n.agency = a.agency AND n.season = y.season")
def agency_spine(spark, d):
    dims = [spark.createDataFrame([(a,) for a in AGENCIES], "agency string"), spark.range(1, 32).select(F.col("id").cast("int").alias("season"))]
    return density.spine(dims, points(spark, d).where(F.col("wind") >= SUPER).groupBy("agency", "season").agg(F.count("*").alias("n")), ["agency", "season"], {"n": 0})


@query("total_variation", f"WITH {PTS}, {MEANS} SELECT round(0.5 * sum(abs(late - early)), 9) AS tv FROM means")
def total_variation(spark, d):
    return contrast.total_variation(density.composition(points(spark, d)), EARLY, LATE).withColumn("tv", F.round("tv", 9))


@query("projection_index", f"WITH {PTS}, {MEANS}, k AS (SELECT sum((late - early) ** 2) AS pp, sum((late + early) / 2 * (late - early)) AS mp FROM means) SELECT season, round(2 * (sum(share * (late - early)) - any_value(mp)) / any_value(pp), 6) AS index FROM shares JOIN means USING (cell_id), k GROUP BY season")
def projection_index(spark, d):
    return r6(contrast.projection_index(density.composition(points(spark, d)), EARLY, LATE), "index")


@query("between_within", f"""WITH {PTS}, {CELLS}, j AS (SELECT season, agency, cell_id, count(*) / sum(count(*)) OVER (PARTITION BY season)::DOUBLE AS share FROM cells GROUP BY season, agency, cell_id),
ny AS (SELECT count(DISTINCT season) FILTER (season <= 15) AS ne, count(DISTINCT season) FILTER (season > 15) AS nl FROM j),
m AS (SELECT agency, cell_id, coalesce(sum(share) FILTER (season <= 15), 0) / any_value(ne) AS je, coalesce(sum(share) FILTER (season > 15), 0) / any_value(nl) AS jl FROM j, ny GROUP BY ALL),
p AS (SELECT *, sum(je) OVER (PARTITION BY agency) AS pe, sum(jl) OVER (PARTITION BY agency) AS pl FROM m), g AS (SELECT *, coalesce(je / nullif(pe, 0), 0) AS ge, coalesce(jl / nullif(pl, 0), 0) AS gl FROM p)
SELECT cell_id, round(sum((pl - pe) * (ge + gl) / 2), 9) + 0 AS between, round(sum((pe + pl) / 2 * (gl - ge)), 9) + 0 AS within, round(sum(jl - je), 9) + 0 AS change FROM g GROUP BY cell_id""")
def between_within(spark, d):
    p = density.with_cell(points(spark, d)).groupBy("season", "agency", "cell_id").agg(F.count("*").alias("n"))
    joint = p.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("season"))).drop("n")
    out = contrast.between_within(joint, "agency", EARLY, LATE)
    return out.select("cell_id", *[(F.round(c, 9) + 0.0).alias(c) for c in ("between", "within", "change")])


STATE = f"{PTS}, {CELLS}, st AS (SELECT season, agency AS cell_id, count(*) / sum(count(*)) OVER (PARTITION BY season)::DOUBLE AS w, avg(wind) AS h FROM cells GROUP BY season, agency)"


@query("exposure_change", f"""WITH {STATE}, a AS (SELECT cell_id, avg(w) FILTER (season <= 15) AS we, avg(w) FILTER (season > 15) AS wl, avg(h) FILTER (season <= 15) AS he, avg(h) FILTER (season > 15) AS hl, avg(w * h) FILTER (season <= 15) AS xe, avg(w * h) FILTER (season > 15) AS xl FROM st GROUP BY cell_id)
SELECT round(sum(xl - xe), 6) AS delta, round(sum((wl - we) * (he + hl) / 2), 6) AS redistribution, round(sum((we + wl) / 2 * (hl - he)), 6) AS state_change, round(sum(xl - xe) - sum((wl - we) * (he + hl) / 2) - sum((we + wl) / 2 * (hl - he)), 6) AS covariation FROM a""")
def exposure_change(spark, d):
    p = density.with_cell(points(spark, d)).groupBy("season", F.col("agency").alias("cell_id")).agg(F.count("*").alias("n"), F.avg("wind").alias("h"))
    state = p.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("season")))
    return r6(contrast.exposure_change(state, EARLY, LATE), "delta", "redistribution", "state_change", "covariation")


@query("three_term_speed", f"""WITH {TRK.replace("value AS wind", "value AS wind, day(ts) AS season")}, {seg('trk')}, b AS (SELECT season, floor(lat)::BIGINT AS band, count(*) AS n, avg(dist_km / dt_h) AS v FROM seg GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY season)::DOUBLE AS f FROM b),
ny AS (SELECT count(DISTINCT season) FILTER (season <= 15) AS ne, count(DISTINCT season) FILTER (season BETWEEN 16 AND 31) AS nl FROM f),
m AS (SELECT band, coalesce(sum(f) FILTER (season <= 15), 0) / any_value(ne) AS fe, coalesce(sum(f) FILTER (season > 15), 0) / any_value(nl) AS fl, avg(v) FILTER (season <= 15) AS v1, avg(v) FILTER (season > 15) AS v2 FROM f, ny GROUP BY band), g AS (SELECT fe, fl, coalesce(v1, v2) AS ve, coalesce(v2, v1) AS vl FROM m)
SELECT round(sum((fl - fe) * ve), 6) AS shift, round(sum(fe * (vl - ve)), 6) AS regional, round(sum((fl - fe) * (vl - ve)), 6) AS joint, round(sum(fl * vl - fe * ve), 6) AS total FROM g""")
def three_term_speed(spark, d):
    s = tracks.segments(smooth(spark, d)).withColumns({"season": F.dayofmonth("iso_time"), "speed": F.col("dist_km") / F.col("dt_h")})
    return r6(contrast.three_term(s, EARLY, LATE), "shift", "regional", "joint", "total")


@query("bh_fdr", f"WITH {PTS}, t AS (SELECT agency, season, CASE WHEN season % 7 = 0 THEN NULL ELSE round(avg(lat) / 40, 6) END AS p FROM pts GROUP BY agency, season), k AS (SELECT *, p * count(p) OVER (PARTITION BY agency) / row_number() OVER (PARTITION BY agency ORDER BY p NULLS LAST, season) AS x FROM t) SELECT agency, season, p, CASE WHEN p IS NOT NULL THEN round(least(1.0::DOUBLE, min(x) OVER (PARTITION BY agency ORDER BY p NULLS LAST, season ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) END AS q FROM k")
def bh_fdr(spark, d):
    t = points(spark, d).groupBy("agency", "season").agg(F.round(F.avg("lat") / 40, 6).alias("p"))
    t = t.withColumn("p", F.when(F.col("season") % 7 != 0, F.col("p")))
    return inference.bh_fdr(t, "p", ["agency"]).withColumn("q", F.round("q", 9))


@query("theil_sen", f"WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS v FROM pts GROUP BY ALL) SELECT a.agency, round(median((b.v - a.v) / (b.season - a.season)), 6) AS slope, sum(sign(b.v - a.v))::DOUBLE AS mk_s FROM m a JOIN m b ON a.agency = b.agency AND a.season < b.season GROUP BY a.agency")
def theil_sen(spark, d):
    m = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"))
    return r6(inference.theil_sen(m, ["agency"], "season", "v"), "slope")


@query("detrended", f"WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS v FROM pts GROUP BY ALL), f AS (SELECT agency, regr_slope(v, season) AS s, regr_intercept(v, season) AS i FROM m GROUP BY agency) SELECT agency, season, round(v - i - s * season, 6) AS resid FROM m JOIN f USING (agency)")
def detrended(spark, d):
    m = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"))
    return r6(inference.detrend(m, ["agency"], "season", "v").select("agency", "season", "resid"), "resid")


@query("ar1", f"WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS v FROM pts GROUP BY ALL), l AS (SELECT agency, v, lag(v) OVER (PARTITION BY agency ORDER BY season) AS b FROM m) SELECT agency, round(covar_pop(v, b) / nullif(stddev_pop(v) * stddev_pop(b), 0), 6) AS ar1, count(*) AS n_pairs FROM l WHERE b IS NOT NULL GROUP BY agency")
def ar1(spark, d):
    m = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"))
    return r6(inference.ar1(m, "season", "v", ["agency"]), "ar1")


SHUFFLES = 999
BLOCKS = "yrs AS (SELECT DISTINCT season FROM pts), isl AS (SELECT season, season - row_number() OVER (ORDER BY season) AS island FROM yrs), prt AS (SELECT *, floor((row_number() OVER (PARTITION BY island ORDER BY season) - 1) / 3) AS part FROM isl), blk AS (SELECT season, dense_rank() OVER (ORDER BY island, part) - 1 AS block FROM prt)"
PLACES = "plc AS (SELECT rep, season, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN lpad(block::VARCHAR, 8, '0') ELSE md5('11_' || rep || '_' || block) END, block, season) - 1 AS position FROM (SELECT unnest(range(%d)) AS rep), blk)" % (SHUFFLES + 1)


def blocks_of(spark, d):
    return tracks.year_blocks(seasons(spark, d), 3)


@query("year_blocks", f"WITH {PTS}, {BLOCKS} SELECT season, block FROM blk")
def year_blocks(spark, d):
    return blocks_of(spark, d)


@query("permutation_difference", f"WITH {PTS}, {DAILY}, {BLOCKS}, {PLACES}, r AS (SELECT rep, avg(lat) FILTER (position >= 15) - avg(lat) FILTER (position < 15) AS d FROM plc JOIN daily USING (season) GROUP BY rep), o AS (SELECT d AS observed FROM r WHERE rep = 0) SELECT round(max(observed), 6) AS difference, round((sum((round(abs(d), 9) >= round(abs(observed), 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM r, o WHERE rep > 0")
def permutation_difference(spark, d):
    return r6(inference.permutation_difference(daily(spark, d), blocks_of(spark, d), 15, SHUFFLES, 11, "lat"), "difference", "p_value")


@query("permutation_tv", f"WITH {PTS}, {SHARES}, {BLOCKS}, {PLACES}, n AS (SELECT count(*) AS n FROM blk), c AS (SELECT rep, cell_id, sum(CASE WHEN position >= 15 THEN share ELSE 0 END) / any_value(n - 15) - sum(CASE WHEN position < 15 THEN share ELSE 0 END) / 15 AS d FROM plc JOIN shares USING (season), n GROUP BY rep, cell_id), t AS (SELECT rep, 0.5 * sum(abs(d)) AS tv FROM c GROUP BY rep), o AS (SELECT tv AS observed FROM t WHERE rep = 0) SELECT round(max(observed), 6) AS tv, round((sum((round(tv, 9) >= round(observed, 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM t, o WHERE rep > 0")
def permutation_tv(spark, d):
    return r6(inference.permutation_tv(density.composition(points(spark, d)), blocks_of(spark, d), 15, SHUFFLES, 11), "tv", "p_value")


@query("ols_simple", f"WITH {PTS} SELECT 'const' AS term, round(regr_intercept(wind, lat), 4) AS coef FROM pts UNION ALL SELECT 'lat', round(regr_slope(wind, lat), 4) FROM pts")
def ols_simple(spark, d):
    return inference.ols(points(spark, d), "wind", ["lat"]).withColumn("coef", F.round("coef", 4))


@query("robust_z", f"WITH {PTS}, {DAILY}, m AS (SELECT median(wind) AS m FROM daily), s AS (SELECT median(abs(wind - m)) * 1.4826 AS s FROM daily, m) SELECT season, CASE WHEN s = 0 THEN CASE WHEN wind = m THEN 0.0 ELSE 'inf'::DOUBLE END ELSE round((wind - m) / s, 6) END AS z FROM daily, m, s")
def robust_z(spark, d):
    return r6(inference.robust_z(daily(spark, d), "wind").select("season", "z"), "z")


FIELD = f"{PTS}, fld AS (SELECT season, 2.5::DOUBLE + 5 * floor(lat / 5) AS lat, 102.5::DOUBLE + 5 * floor((lon - 100) / 5) AS lon, avg(wind) - 60 AS v FROM pts WHERE lat < 40 AND lon < 180 GROUP BY ALL)"


def field(spark, d):
    p = points(spark, d).where("lat < 40 AND lon < 180")
    return p.groupBy("season", (F.lit(2.5) + 5 * F.floor(F.col("lat") / 5)).alias("lat"), (F.lit(102.5) + 5 * F.floor((F.col("lon") - 100) / 5)).alias("lon")).agg((F.avg("wind") - 60).alias("v"))


@query("field_weighted_mean", f"WITH {FIELD} SELECT season, round(sum(cos(radians(lat)) * v) / sum(cos(radians(lat))), 6) AS mean FROM fld GROUP BY season")
def field_weighted_mean(spark, d):
    return r6(fields.weighted_mean(field(spark, d), ["season"], "v"), "mean")


@query("field_above_contour", f"WITH {FIELD}, a AS (SELECT *, 6371.0::DOUBLE ** 2 * radians(5) * radians(5) * cos(radians(lat)) AS area FROM fld) SELECT season, round(coalesce(sum(area) FILTER (v >= 10), 0), 3) AS area_km2, round(coalesce(sum((v - 5) * area) FILTER (v >= 10), 0) / 1e6, 6) AS intensity, min(lon) FILTER (v >= 10) AS west_lon FROM a GROUP BY season")
def field_above_contour(spark, d):
    return r6(fields.above_contour(field(spark, d), ["season"], "v", 10.0, 5.0, 5.0, 5.0), "intensity").withColumn("area_km2", F.round("area_km2", 3))


@query("ridge_latitude", f"WITH {FIELD}, l AS (SELECT *, lead(v) OVER w AS v2, lead(lat) OVER w AS lat2 FROM fld WINDOW w AS (PARTITION BY season, lon ORDER BY lat)), f AS (SELECT * FROM l WHERE v < 0 AND v2 >= 0 QUALIFY row_number() OVER (PARTITION BY season, lon ORDER BY lat) = 1) SELECT season, round(avg(lat + (lat2 - lat) * -v / (v2 - v)), 6) AS ridge_lat, count(*) AS n_lons FROM f GROUP BY season")
def ridge_latitude(spark, d):
    return r6(fields.ridge_latitude(field(spark, d), ["season"], "v"), "ridge_lat")


@query("layer_mean", f"WITH {FIELD}, l AS (SELECT *, lead(v) OVER w AS v2, lead(lat) OVER w AS p2 FROM fld WINDOW w AS (PARTITION BY season, lon ORDER BY lat)) SELECT season, lon, round(sum((v + v2) / 2 * (p2 - lat)) / nullif(max(lat) - min(lat), 0), 6) AS layer_mean FROM l GROUP BY season, lon")
def layer_mean(spark, d):
    return r6(fields.layer_mean(field(spark, d), ["season", "lon"], "lat", "v"), "layer_mean")


@query("composite_difference", f"WITH {FIELD} SELECT lat, lon, round(avg(v) FILTER (season > 15) - avg(v) FILTER (season <= 15), 6) AS difference FROM fld GROUP BY lat, lon")
def composite_difference(spark, d):
    f = field(spark, d).withColumn("label", F.when(F.col("season") > 15, "late").otherwise("early"))
    return r6(fields.composite_difference(f, ["lat", "lon"], "v", "label", "late", "early"), "difference")


@query("pivot_counts", f"WITH {PTS} SELECT season, count(*) FILTER (agency = 'USA') AS usa, count(*) FILTER (agency = 'TOKYO') AS tokyo, count(*) FILTER (agency = 'CMA') AS cma FROM pts GROUP BY season")
def pivot_counts(spark, d):
    p = points(spark, d).groupBy("season").pivot("agency", list(AGENCIES)).count().na.fill(0)
    return p.select("season", F.col("USA").alias("usa"), F.col("TOKYO").alias("tokyo"), F.col("CMA").alias("cma"))


@query("unpivot_metrics", f"WITH {PTS}, {DAILY} SELECT season, 'lat' AS metric, round(lat, 6) AS value FROM daily UNION ALL SELECT season, 'wind', round(wind, 6) FROM daily")
def unpivot_metrics(spark, d):
    return r6(daily(spark, d).unpivot("season", ["lat", "wind"], "metric", "value"), "value")


@query("rank_remap", f"WITH {PTS}, n AS (SELECT sid, agency, count(*) AS v FROM pts GROUP BY ALL), t AS (SELECT sid, row_number() OVER (ORDER BY v, sid) AS r, count(*) OVER () AS n FROM n WHERE agency = 'USA'), dn AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, lead(v) OVER (ORDER BY v) AS nx, count(*) OVER () AS m FROM n WHERE agency = 'CMA'), p AS (SELECT sid, (r - 0.5::DOUBLE) / n * ((SELECT max(m) FROM dn) - 1) AS pos FROM t) SELECT sid, round(v + (pos - i) * (coalesce(nx, v) - v), 6) AS remapped FROM p JOIN dn ON floor(pos) = i")
def rank_remap(spark, d):
    n = points(spark, d).groupBy("sid", "agency").agg(F.count("*").alias("v"))
    return r6(tracks.rank_remap(n.where("agency = 'USA'"), n.where("agency = 'CMA'"), "v"), "remapped")


@query("shapley", f"""WITH {PTS}, {CELLS}, e AS (SELECT sid, season, arg_min(floor(lat / 10)::BIGINT, (iso_time, event_id)) AS bin, count(*) AS n FROM cells GROUP BY ALL),
y AS (SELECT season, count(*) AS ny FROM e GROUP BY season), k AS (SELECT count(*) FILTER (season <= 15) AS ye, count(*) FILTER (season > 15) AS yl FROM y),
w AS (SELECT e.*, CASE WHEN e.season <= 15 THEN 'e' ELSE 'l' END AS p, 1.0::DOUBLE / (CASE WHEN e.season <= 15 THEN ye ELSE yl END * ny) AS w FROM e JOIN y ON e.season = y.season, k),
b AS (SELECT bin, sum(w) FILTER (p = 'e') AS we, sum(w) FILTER (p = 'l') AS wl FROM w GROUP BY bin HAVING count(*) FILTER (p = 'e') >= 3 AND count(*) FILTER (p = 'l') >= 3),
g AS (SELECT bin, we, wl, we / sum(we) OVER () AS ge, wl / sum(wl) OVER () AS gl FROM b),
c AS (SELECT g.bin, x.cell_id, any_value(ge) AS ge, any_value(gl) AS gl, coalesce(sum(w.w / w.n) FILTER (p = 'e'), 0) / any_value(we) AS se, coalesce(sum(w.w / w.n) FILTER (p = 'l'), 0) / any_value(wl) AS sl FROM w JOIN g USING (bin) JOIN cells x ON x.sid = w.sid AND x.season = w.season GROUP BY g.bin, x.cell_id)
SELECT cell_id, round(sum((gl - ge) * (se + sl) / 2), 9) + 0 AS genesis, round(sum((ge + gl) / 2 * (sl - se)), 9) + 0 AS propagation, round(sum(gl * sl - ge * se), 9) + 0 AS change FROM c GROUP BY cell_id""")
def shapley(spark, d):
    p = density.with_cell(points(spark, d)).withColumn("start", F.floor(F.col("lat") / 10))
    return contrast.shapley(p, EARLY, LATE, "start").select("cell_id", *[(F.round(c, 9) + 0.0).alias(c) for c in ("genesis", "propagation", "change")])


@query("block_bootstrap", f"WITH {PTS}, {DAILY}, own AS (SELECT CASE WHEN season <= 15 THEN 'e' ELSE 'l' END AS period, lat, season FROM daily), o AS (SELECT period, lat, row_number() OVER (PARTITION BY period ORDER BY season) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM own), dr AS (SELECT rep, k, period, n, ((('0x' || substr(md5('5_' || period || '_' || rep || '_' || (k // 3)), 1, 8))::BIGINT + k % 3) % n) AS i FROM (SELECT unnest(range(200)) AS rep), (SELECT unnest(range(15)) AS k), (SELECT DISTINCT period, n FROM o)), m AS (SELECT rep, avg(lat) FILTER (dr.period = 'l') - avg(lat) FILTER (dr.period = 'e') AS d FROM dr JOIN o ON o.period = dr.period AND o.i = dr.i GROUP BY rep) SELECT round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM m")
def block_bootstrap(spark, d):
    return r6(inference.block_bootstrap(daily(spark, d), "lat", 15, 3, 200, 5, EARLY, LATE), "low", "high")


@query("vif", f"WITH {PTS} SELECT unnest(['lat', 'lon']) AS term, round(1 / (1 - corr(lat, lon) ** 2), 6) AS vif FROM pts")
def vif(spark, d):
    return r6(models.vif(points(spark, d), ["lat", "lon"]), "vif")


@query("adjusted_rand", f"WITH {PTS}, c AS (SELECT agency, nature, count(*)::DOUBLE AS n FROM pts GROUP BY ALL), a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY agency)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY nature)), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c) SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 9) + 0 AS ari FROM a, b, t")
def adjusted_rand(spark, d):
    return models.adjusted_rand(points(spark, d), "agency", "nature").withColumn("ari", F.round("ari", 9) + 0.0)


@query("wavelet_spectrum")
def wavelet_spectrum(spark, d):
    m = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"))
    return models.wavelet_spectrum(m, ["agency"], "season", "v")


@query("hac_regression", f"""WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS x, avg(wind) AS y FROM pts GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY season) AS k FROM m WHERE x IS NOT NULL AND y IS NOT NULL),
 b AS (SELECT agency, count(*) AS c, sum(x) AS sx, sum(x * x) AS sxx, regr_sxx(y, x) * count(*) AS det, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM n GROUP BY agency),
 g AS (SELECT agency, k, x, y - b0 - b1 * x AS e FROM n JOIN b USING (agency)),
 s AS (SELECT u.agency, sum(w * u.e * v.e) AS s00, sum(w * u.e * v.e * v.x) AS s01, sum(w * u.e * v.e * u.x * v.x) AS s11 FROM g u JOIN g v ON u.agency = v.agency AND abs(u.k - v.k) <= 3, LATERAL (SELECT 1 - abs(u.k - v.k) / 4.0::DOUBLE AS w) GROUP BY u.agency)
SELECT agency, 'const' AS term, round(b0, 4) AS coef, round(sqrt(greatest(sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11, 0)) / det, 4) AS se FROM b JOIN s USING (agency)
UNION ALL SELECT agency, 'x', round(b1, 4), round(sqrt(greatest(sx * sx * s00 - 2 * sx * c * s01 + c * c * s11, 0)) / det, 4) FROM b JOIN s USING (agency)""")
def hac_regression(spark, d):
    m = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("x"), F.avg("wind").alias("y"))
    return models.hac_regression(m, ["agency"], "season", "y", ["x"]).withColumns({c: F.round(c, 4) for c in ("coef", "se")})


CENTERS = [[0.1] * 64, [-0.1] * 64, [0.1, -0.1] * 32]


@query("fuzzy_membership", f"""WITH x AS (SELECT vec_id, [{', '.join(f"list_sum(list_transform(list_zip(embedding, {c}::DOUBLE[]), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))" for c in CENTERS)}] AS d FROM (SELECT vec_id, CASE WHEN list_count(embedding) = len(embedding) THEN embedding END AS embedding FROM embeddings)),
 w AS (SELECT vec_id, list_transform(d, lambda z: CASE WHEN z IS NOT NULL THEN 1 / greatest(z, 1e-24) END) AS w FROM x) SELECT vec_id, unnest(range(3))::INT AS center, round(unnest(w) / list_sum(w), 6) AS membership FROM w""")
def fuzzy_membership(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return r6(inference.fuzzy_membership(e, "v", CENTERS).select("vec_id", F.posexplode("membership").alias("center", "membership")), "membership")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year by year place of the point composition between two periods."""
    return projection_index(spark, sf_dir)
