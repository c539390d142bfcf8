"""Named queries of the relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import density, fields, inference, joins, tracks
from ..operators import relational as rel
from ..sources.adapters import AGENCIES, points, table
from ..sources.adapters import tracks as smooth
from .registry import CELLS, COAST, DAILY, EARLY, FIELD, LATE, MEANS, PTS, SHARES, TRK, coast_points, daily, dist, field, query, r6, seg

STATUS = "CASE event_id % 4 WHEN 0 THEN 'EX' WHEN 1 THEN ' ts' WHEN 2 THEN NULL ELSE 'DB' END"
RASTER = "ras AS (SELECT r.r::INT AS row, c.c::INT AS col, (r.r * 7 + c.c * 3) % 5 < 2 AS land FROM (SELECT unnest(range(6)) AS r) r, (SELECT unnest(range(14)) AS c) c)"
YEARLY = "yl AS (SELECT agency, season, avg(lat) AS v, avg(wind) AS w, count(*) AS n FROM pts GROUP BY ALL)"


def raster(spark):
    """Six rows and fourteen columns of 5 degrees from 105 E, 35 N."""
    cells = spark.range(84).select(F.floor(F.col("id") / 14).cast("int").alias("row"), (F.col("id") % 14).cast("int").alias("col"))
    return cells.withColumn("land", (F.col("row") * 7 + F.col("col") * 3) % 5 < 2)


def yearly(spark, d):
    return points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"), F.avg("wind").alias("w"), F.count("*").alias("n"))


@query("half_open_band", f"WITH {PTS} SELECT season, count(*) AS n FROM pts WHERE lat >= 10 AND lat < 20 GROUP BY season")
def half_open_band(spark, d):
    return points(spark, d).where(rel.between_left(F.col("lat"), 10, 20)).groupBy("season").agg(F.count("*").alias("n"))


@query("exclude_substring", f"WITH {PTS} SELECT nature, count(*) AS n FROM pts WHERE NOT contains(lower(coalesce(nature, '')), 'ick') GROUP BY nature")
def exclude_substring(spark, d):
    return points(spark, d).where(rel.without_word(F.col("nature"), "ICK")).groupBy("nature").agg(F.count("*").alias("n"))


@query("native_stage", f"WITH {PTS}, s AS (SELECT *, {STATUS} AS status, (event_id % 10)::INT AS grade FROM pts) SELECT agency, count(*) AS n FROM s WHERE CASE agency WHEN 'USA' THEN wind >= 34 AND upper(trim(coalesce(status, ''))) NOT IN {rel.NOT_TROPICAL} WHEN 'TOKYO' THEN grade IN {rel.GRADES} ELSE grade IN {rel.CATEGORIES} END GROUP BY agency")
def native_stage(spark, d):
    e = F.col("event_id") % 4
    p = points(spark, d).withColumn("status", F.when(e == 0, "EX").when(e == 1, " ts").when(e == 3, "DB")).withColumn("grade", (F.col("event_id") % 10).cast("int"))
    return p.where(rel.native_stage(F.col("agency"), F.col("wind"), F.col("status"), F.col("grade"))).groupBy("agency").agg(F.count("*").alias("n"))


@query("months_filter", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE month(o_orderdate) IN (6, 7, 8, 9, 10) GROUP BY 1")
def months_filter(spark, d):
    o = table(spark, d, "orders").where(rel.in_months(F.col("o_orderdate"), 6, 7, 8, 9, 10))
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("threshold_labels", f"WITH {PTS}, c AS (SELECT *, {COAST} AS coast FROM pts), t AS (SELECT *, unnest([25.0, 50.0, 75.0, 100.0]::DOUBLE[]) AS threshold FROM c) SELECT threshold, CASE WHEN lat * 3 <= threshold THEN coast ELSE 'Other' END AS coast, count(*) AS n FROM t GROUP BY ALL")
def threshold_labels(spark, d):
    p = coast_points(spark, d).withColumn("km", F.col("lat") * 3)
    return rel.threshold_labels(p, "coast", "km", [25, 50, 75, 100]).groupBy("threshold", "coast").agg(F.count("*").alias("n"))


@query("quadrant_shares", f"WITH {PTS} SELECT season, round(avg((lat >= 20 AND lon < 140)::INT), 6) AS nw, round(avg((lat >= 20 AND lon >= 140)::INT), 6) AS ne, round(avg((lat < 20 AND lon < 140)::INT), 6) AS sw, round(avg((lat < 20 AND lon >= 140)::INT), 6) AS se FROM pts GROUP BY season")
def quadrant_shares(spark, d):
    n, w = F.col("lat") >= 20, F.col("lon") < 140
    share = lambda c: F.round(F.avg(F.when(c, 1).otherwise(0)), 6)
    return points(spark, d).groupBy("season").agg(share(n & w).alias("nw"), share(n & ~w).alias("ne"), share(~n & w).alias("sw"), share(~n & ~w).alias("se"))


@query("without_decade", f"WITH {PTS}, t AS (SELECT * FROM (VALUES (1, 10), (11, 20), (21, 31)) v(a, b)) SELECT a AS dropped, round(avg(lat), 6) AS mean, count(*) AS n FROM pts JOIN t ON season NOT BETWEEN a AND b GROUP BY a")
def without_decade(spark, d):
    sums = points(spark, d).groupBy(F.when(F.col("season") <= 10, 1).when(F.col("season") <= 20, 11).otherwise(21).alias("decade")).agg(F.sum("lat").alias("s"), F.count("*").alias("n"))
    everything = Window.partitionBy()  # a row a decade
    s, n = F.sum("s").over(everything) - F.col("s"), F.sum("n").over(everything) - F.col("n")
    return r6(sums.select(F.col("decade").alias("dropped"), (s / n).alias("mean"), n.alias("n")), "mean")


@query("hellinger", f"WITH {PTS}, {SHARES} SELECT season, cell_id, round(sqrt(share), 9) AS root FROM shares")
def hellinger(spark, d):
    return density.composition(points(spark, d), "point").select("season", "cell_id", F.round(F.sqrt("share"), 9).alias("root"))


@query("standardised", f"WITH {PTS}, {YEARLY} SELECT agency, season, round((v - avg(v) OVER k) / nullif(stddev_samp(v) OVER k, 0), 6) AS z1, round((v - avg(v) OVER k) / nullif(stddev_pop(v) OVER k, 0), 6) AS z0 FROM yl WINDOW k AS (PARTITION BY agency)")
def standardised(spark, d):
    return r6(rel.standardised(yearly(spark, d), ["agency"], "v").select("agency", "season", "z1", "z0"), "z1", "z0")


@query("raster_state", f"WITH {PTS}, {RASTER} SELECT CASE WHEN land IS NULL THEN 'outside' WHEN land THEN 'land' ELSE 'sea' END AS state, count(*) AS n FROM pts LEFT JOIN ras ON col = trunc((lon - 105) / 5)::INT AND row = trunc((35 - lat) / 5)::INT GROUP BY 1")
def raster_state(spark, d):
    found = rel.raster_state(points(spark, d), raster(spark), 105.0, 35.0, 5.0)
    return found.groupBy(F.when(F.col("land").isNull(), "outside").when(F.col("land"), "land").otherwise("sea").alias("state")).agg(F.count("*").alias("n"))


@query("raster_class", f"WITH {PTS}, {RASTER}, p AS (SELECT (lon - 105) / 5 AS x, (35 - lat) / 5 AS y FROM pts), q AS (SELECT CASE WHEN x BETWEEN 0 AND 14 AND y BETWEEN 0 AND 6 THEN least(floor(x), 13)::INT END AS c, CASE WHEN x BETWEEN 0 AND 14 AND y BETWEEN 0 AND 6 THEN least(floor(y), 5)::INT END AS r FROM p) SELECT CASE WHEN q.r IS NULL THEN -1 ELSE coalesce(land::INT, 0) END AS state, count(*) AS n FROM q LEFT JOIN ras ON col = c AND row = r GROUP BY 1")
def raster_class(spark, d):
    return rel.raster_class(points(spark, d), raster(spark), 105.0, 35.0, 5.0, 6, 14).groupBy("state").agg(F.count("*").alias("n"))


@query("family_keys", f"WITH {PTS} SELECT concat_ws('_', 'track', agency, nature) AS family, count(*) AS n FROM pts GROUP BY 1")
def family_keys(spark, d):
    return points(spark, d).groupBy(F.concat_ws("_", F.lit("track"), "agency", "nature").alias("family")).agg(F.count("*").alias("n"))


@query("season_of_id", f"WITH {PTS} SELECT try_cast(substr(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END || year(iso_time) || '-' || sid, 1, 4) AS INT) AS year, count(*) AS n FROM pts GROUP BY 1")
def season_of_id(spark, d):
    sid = F.concat(F.when(F.col("event_id") % 7 == 0, "x").otherwise(""), F.year("iso_time").cast("string"), F.lit("-"), F.col("sid").cast("string"))
    return points(spark, d).groupBy(rel.season_of_id(sid).alias("year")).agg(F.count("*").alias("n"))


@query("analysis_views", f"WITH {PTS}, v AS (SELECT *, floor(lon / 4) % 2 = 0 AS land, (event_id % 20 <> 0) AS aligned FROM pts), w AS (SELECT 'calendar_year' AS year_assignment, 'ocean_points_only' AS land_treatment, lat FROM v WHERE NOT land UNION ALL SELECT 'calendar_year', 'nearest_ocean_all_points', lat FROM v UNION ALL SELECT 'season_year_aligned_only', 'ocean_points_only', lat FROM v WHERE NOT land AND aligned UNION ALL SELECT 'season_year_aligned_only', 'nearest_ocean_all_points', lat FROM v WHERE aligned) SELECT year_assignment, land_treatment, count(*) AS n, round(avg(lat), 6) AS mean FROM w GROUP BY ALL")
def analysis_views(spark, d):
    land, aligned = F.floor(F.col("lon") / 4) % 2 == 0, F.col("event_id") % 20 != 0
    kinds = [(y, t, (F.lit(True) if y[0] == "c" else aligned) & (F.lit(True) if t[0] == "n" else ~land)) for y in ("calendar_year", "season_year_aligned_only") for t in ("ocean_points_only", "nearest_ocean_all_points")]
    views = F.filter(F.array(*[F.struct(F.lit(y).alias("year_assignment"), F.lit(t).alias("land_treatment"), c.alias("held")) for y, t, c in kinds]), lambda v: v["held"])
    p = points(spark, d).withColumn("view", F.explode(views)).select("lat", "view.*")
    return p.groupBy("year_assignment", "land_treatment").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("mean"))


@query("labelled_bins", f"WITH {PTS}, l AS (SELECT 'latitude' AS aggregation, CASE WHEN lat < 10 THEN 'deep' WHEN lat < 20 THEN 'low' WHEN lat < 30 THEN 'mid' ELSE 'high' END AS bin, wind FROM pts UNION ALL SELECT 'longitude', CASE WHEN lon < 140 THEN 'west' ELSE 'east' END, wind FROM pts) SELECT aggregation, bin, count(*) AS n, round(sum(wind), 3) AS total FROM l GROUP BY ALL")
def labelled_bins(spark, d):
    labels = {"latitude": rel.ladder(F.col("lat"), [10, 20, 30], ["deep", "low", "mid", "high"]), "longitude": rel.ladder(F.col("lon"), [140], ["west", "east"])}
    return rel.labelled(points(spark, d), labels).groupBy("aggregation", "bin").agg(F.count("*").alias("n"), F.round(F.sum("wind"), 3).alias("total"))


@query("region_mean", f"WITH {FIELD} SELECT season, round(avg(v), 6) AS mean FROM fld WHERE lon BETWEEN 120 AND 150 AND lat BETWEEN 10 AND 25 GROUP BY season")
def region_mean(spark, d):
    return r6(field(spark, d).where(F.col("lon").between(120, 150) & F.col("lat").between(10, 25)).groupBy("season").agg(F.avg("v").alias("mean")), "mean")


@query("star_join", f"WITH {PTS}, {YEARLY} SELECT season, round(a.v, 6) AS usa, round(b.v, 6) AS tokyo, round(c.w, 6) AS cma_wind FROM (SELECT season, v FROM yl WHERE agency = 'USA') a JOIN (SELECT season, v FROM yl WHERE agency = 'TOKYO') b USING (season) JOIN (SELECT season, w FROM yl WHERE agency = 'CMA') c USING (season)")
def star_join(spark, d):
    y = yearly(spark, d)
    side = lambda a, c, n: y.where(F.col("agency") == a).select("season", F.round(c, 6).alias(n))
    return rel.star_join(side("USA", "v", "usa"), "season", side("TOKYO", "v", "tokyo"), side("CMA", "w", "cma_wind"))


@query("counts_with_intensity", f"WITH {PTS}, c AS (SELECT *, {COAST} AS coast FROM pts), n AS (SELECT season, coast, count(*) AS n FROM c GROUP BY ALL), i AS (SELECT season, coast, round(avg(wind), 6) AS mean_wind, round(median(wind), 6) AS median_wind FROM c WHERE wind >= 130 GROUP BY ALL) SELECT n.season, n.coast, n, mean_wind, median_wind FROM n LEFT JOIN i ON n.season = i.season AND n.coast = i.coast")
def counts_with_intensity(spark, d):
    strong = F.when(F.col("wind") >= 130, F.col("wind"))
    return r6(coast_points(spark, d).groupBy("season", "coast").agg(F.count("*").alias("n"), F.avg(strong).alias("mean_wind"), F.median(strong).alias("median_wind")), "mean_wind", "median_wind")


@query("endpoint_states", f"WITH {PTS}, o AS (SELECT sid, event_id AS start_event_id, lead(event_id) OVER (PARTITION BY sid ORDER BY iso_time, event_id) AS end_event_id FROM pts), st AS (SELECT event_id, wind >= 34 AS stage FROM pts WHERE event_id % 3 <> 1) SELECT s.stage AS start_stage, e.stage AS end_stage, count(*) AS n FROM o LEFT JOIN st s ON s.event_id = start_event_id LEFT JOIN st e ON e.event_id = end_event_id WHERE end_event_id IS NOT NULL GROUP BY ALL")
def endpoint_states(spark, d):
    p = points(spark, d)
    own = p.select("sid", F.col("event_id").alias("start_event_id"), F.lead("event_id").over(tracks.in_order()).alias("end_event_id")).where("end_event_id IS NOT NULL")
    states = p.where("event_id % 3 <> 1").select("event_id", (F.col("wind") >= 34).alias("stage"))
    return rel.endpoint_states(own, states, ["event_id"], "stage").groupBy("start_stage", "end_stage").agg(F.count("*").alias("n"))


@query("reattach", f"WITH {PTS}, u AS (SELECT sid, iso_time, agency, lat, NULL::DOUBLE AS lon, event_id, 0 AS rank FROM pts WHERE wind >= 130 UNION ALL SELECT p.sid, p.iso_time, p.agency, p.lat, p.lon, p.event_id, 1 FROM pts p SEMI JOIN (SELECT * FROM pts WHERE wind >= 100 AND wind < 140) x ON x.sid = p.sid AND x.iso_time = p.iso_time AND x.agency = p.agency) SELECT agency, count(*) AS n, count(lon) AS n_reattached FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY sid, iso_time, agency ORDER BY rank, event_id) = 1) GROUP BY agency")
def reattach(spark, d):
    p, keys = points(spark, d), ["sid", "iso_time", "agency"]
    exact = p.where("wind >= 130").select(*keys, "lat", "event_id", F.lit(0).alias("rank"))
    out = rel.reattach(exact, p.where("wind >= 100 AND wind < 140"), p.select(*keys, "lat", "lon", "event_id", F.lit(1).alias("rank")), keys, ["rank", "event_id"])
    return out.groupBy("agency").agg(F.count("*").alias("n"), F.count("lon").alias("n_reattached"))


@query("demeaned", f"WITH {PTS}, {YEARLY} SELECT agency, season, round(v - avg(v) OVER (PARTITION BY agency), 6) AS apart FROM yl")
def demeaned(spark, d):
    return r6(rel.demean(yearly(spark, d), ["agency"], "v", "apart").select("agency", "season", "apart"), "apart")


@query("first_two", f"WITH {PTS} SELECT sid, agency, event_id FROM pts QUALIFY row_number() OVER (PARTITION BY sid, agency ORDER BY iso_time, event_id) <= 2")
def first_two(spark, d):
    return rel.first_k(points(spark, d), ["sid", "agency"], ["iso_time", "event_id"], 2).select("sid", "agency", "event_id")


@query("nested_sizes", f"WITH {PTS}, g AS (SELECT agency, sid, count(*) AS n FROM pts GROUP BY ALL) SELECT agency, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, round(avg(n), 6) AS mean_size FROM g GROUP BY agency")
def nested_sizes(spark, d):
    return r6(rel.nested_sizes(points(spark, d), "agency", ["sid"]), "mean_size")


@query("north_share_rules", f"WITH {PTS}, c AS (SELECT season, {COAST} AS coast FROM pts), n AS (SELECT season, sum((coast IN ('Japan', 'Korea', 'China_E'))::INT)::DOUBLE AS n, sum((coast IN ('Vietnam', 'Philippines', 'China_S'))::INT)::DOUBLE AS s, sum((coast = 'Taiwan')::INT)::DOUBLE AS b, count(*) AS k FROM c GROUP BY season) SELECT season, round(n / nullif(n + s, 0), 6) AS left_out, round((n + b) / nullif(n + s + b, 0), 6) AS as_north, round(n / nullif(n + s + b, 0), 6) AS as_south, round(n / k, 6) AS of_all FROM n")
def north_share_rules(spark, d):
    c = F.col("coast")
    out = rel.share_with_rules(coast_points(spark, d), "season", c.isin("Japan", "Korea", "China_E"), c.isin("Vietnam", "Philippines", "China_S"), c == "Taiwan")
    return r6(out, "left_out", "as_north", "as_south", "of_all")


@query("monthly_climatology", "WITH m AS (SELECT unnest(range(1, 13))::INT AS month), n AS (SELECT month(o_orderdate)::INT AS month, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), y AS (SELECT count(DISTINCT year(o_orderdate)) AS y FROM orders) SELECT m.month, round(coalesce(n, 0) / y, 6) AS per_year, round(f / n, 6) AS ratio FROM m LEFT JOIN n USING (month), y")
def monthly_climatology(spark, d):
    o = table(spark, d, "orders")
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    n = o.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    out = months.join(n, "month", "left").crossJoin(F.broadcast(o.agg(F.countDistinct(F.year("o_orderdate")).alias("y"))))  # one row
    return out.select("month", F.round(F.coalesce("n", F.lit(0)) / F.col("y"), 6).alias("per_year"), F.round(F.col("f") / F.col("n"), 6).alias("ratio"))


U = "m AS (SELECT *, [1 / (1 + wind), 1 / (1 + abs(wind - 100)), 1 / (1 + abs(wind - 200))] AS a FROM pts), u AS (SELECT season, sid, lat, lon, unnest(a) / list_sum(a) AS u, unnest(range(3))::INT AS k FROM m)"


def members(spark, d):
    """Points once per family, with their membership u in family k."""
    near = F.array(*[1 / (1 + F.abs(F.col("wind") - c)) for c in (0, 100, 200)])
    p = points(spark, d).where("wind >= 0").withColumn("a", near)
    total = F.aggregate("a", F.lit(0.0), lambda t, x: t + x)
    return p.select("season", "sid", "lat", "lon", F.posexplode(F.transform("a", lambda x: x / total)).alias("k", "u"))


@query("fuzzy_composition", f"WITH {PTS.replace('FROM events))', 'FROM events WHERE value >= 0))')}, {U}, s AS (SELECT season, k, sum(u) AS u FROM u GROUP BY ALL) SELECT season, k, round(u, 5) AS weight, round(u / sum(u) OVER (PARTITION BY season), 6) AS share FROM s")
def fuzzy_composition(spark, d):
    s = members(spark, d).groupBy("season", "k").agg(F.sum("u").alias("u"))
    return s.select("season", "k", F.round("u", 5).alias("weight"), F.round(F.col("u") / F.sum("u").over(Window.partitionBy("season")), 6).alias("share"))


@query("weighted_path", f"WITH {PTS.replace('FROM events))', 'FROM events WHERE value >= 0))')}, {U} SELECT season, k, round(sum(u * lat) / sum(u), 6) AS lat, round((sum(u * lon) / sum(u) + 360) % 360, 6) AS lon FROM u GROUP BY season, k")
def weighted_path(spark, d):
    mean = lambda c: F.sum(F.col("u") * F.col(c)) / F.sum("u")
    return r6(members(spark, d).groupBy("season", "k").agg(mean("lat").alias("lat"), F.pmod(mean("lon"), F.lit(360.0)).alias("lon")), "lat", "lon")


@query("relabelled", f"WITH {PTS.replace('FROM events))', 'FROM events WHERE value >= 0))')}, {U}, m2 AS (SELECT k, sum(u * lon) / sum(u) AS mean FROM u GROUP BY k) SELECT k, round(mean, 6) AS mean, (row_number() OVER (ORDER BY mean, k) - 1)::INT AS label FROM m2")
def relabelled(spark, d):
    return r6(rel.relabel(members(spark, d), "k", F.col("u"), "lon"), "mean")


@query("state_usage", f"WITH {PTS}, {CELLS} SELECT cell_id, count(*) FILTER (floor(lon / 4) % 2 = 0) AS n_land, count(*) FILTER (floor(lon / 4) % 2 <> 0) AS n_ocean, count(*) FILTER (floor(lon / 4) % 2 = 0) > 0 AND count(*) FILTER (floor(lon / 4) % 2 <> 0) > 0 AS both FROM cells GROUP BY cell_id")
def state_usage(spark, d):
    land = F.floor(F.col("lon") / 4) % 2 == 0
    n = density.with_cell(points(spark, d)).groupBy("cell_id").agg(F.count(F.when(land, 1)).alias("n_land"), F.count(F.when(~land, 1)).alias("n_ocean"))
    return n.withColumn("both", (F.col("n_land") > 0) & (F.col("n_ocean") > 0))


@query("sign_robustness", f"WITH {PTS}, {YEARLY}, e AS (SELECT agency, v - 20 AS x, v - 20 - 2 AS lo, v - 20 + 2 AS hi FROM yl) SELECT agency, sum((x > 0)::INT)::BIGINT AS n_positive, sum((x < 0)::INT)::BIGINT AS n_negative, sum((lo > 0 OR hi < 0)::INT)::BIGINT AS n_clear, round(min(x), 6) AS least, round(max(x), 6) AS most FROM e GROUP BY agency")
def sign_robustness(spark, d):
    e = yearly(spark, d).select("agency", (F.col("v") - 20).alias("x"))
    return r6(rel.sign_robustness(e.withColumns({"lo": F.col("x") - 2, "hi": F.col("x") + 2}), ["agency"], "x", "lo", "hi"), "least", "most")


@query("factor_sensitivity", f"WITH {PTS}, {YEARLY}, s AS (SELECT b.v - a.v AS shift, 'USA-CMA' AS contrast FROM yl a JOIN yl b ON a.season = b.season AND a.agency = 'USA' AND b.agency = 'CMA') SELECT contrast, round(avg(shift), 6) AS mean, round(median(shift), 6) AS median, round(min(shift), 6) AS least, round(max(shift), 6) AS most, round(median(abs(shift)), 6) AS median_abs, round(max(abs(shift)), 6) AS max_abs FROM s GROUP BY contrast")
def factor_sensitivity(spark, d):
    s = joins.paired_contrast(yearly(spark, d), ["season"], "agency", "USA", "CMA", "v").withColumn("contrast", F.lit("USA-CMA"))
    return r6(rel.factor_sensitivity(s, ["contrast"], "shift"), "mean", "median", "least", "most", "median_abs", "max_abs")


@query("segment_means", f"WITH {PTS}, {DAILY}, s AS (SELECT floor((season - 1) / 10)::BIGINT AS segment, avg(lat) AS mean, count(*) AS n_years FROM daily GROUP BY 1 HAVING count(*) = 10) SELECT segment, round(mean, 6) AS mean, n_years, mean = max(mean) OVER () AS peak FROM s")
def segment_means(spark, d):
    return r6(rel.segment_means(daily(spark, d), "season", 1, 10, "lat"), "mean")


@query("leave_one_range", f"WITH {PTS}, c AS (SELECT *, {COAST} AS coast FROM pts), k AS (SELECT coast, sum(wind) AS s, count(*) AS n FROM c GROUP BY coast), e AS (SELECT coast, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS effect FROM k) SELECT arg_min(coast, effect) AS least_without, round(min(effect), 6) AS least, arg_max(coast, effect) AS most_without, round(max(effect), 6) AS most, round((SELECT avg(wind) FROM pts), 6) AS full, round(min(effect) / (SELECT avg(wind) FROM pts), 6) AS retained FROM e")
def leave_one_range(spark, d):
    from ..operators.annual import leave_one_out

    p = coast_points(spark, d)
    e = leave_one_out(p, None, "coast", "wind").select("excluded", F.col("mean").alias("effect"))
    return r6(rel.leave_one_range(e, p.agg(F.avg("wind").alias("effect"))), "least", "most", "full", "retained")


@query("membership_overlap", f"WITH {PTS}, h AS (SELECT CASE WHEN season <= 15 THEN 'early' ELSE 'late' END AS period, sid, max((agency = 'USA')::INT) AS u, max((agency = 'TOKYO')::INT) AS t, max((agency = 'CMA')::INT) AS c FROM pts GROUP BY ALL) SELECT period, count(*) AS n_any, sum(u)::BIGINT AS n_usa, sum(t)::BIGINT AS n_tokyo, sum(c)::BIGINT AS n_cma, sum(u * t)::BIGINT AS n_usa_tokyo, sum(u * c)::BIGINT AS n_usa_cma, sum(t * c)::BIGINT AS n_tokyo_cma, sum(u * t * c)::BIGINT AS n_all, round(sum(u * t * c) / count(*), 6) AS part_all FROM h GROUP BY period")
def membership_overlap(spark, d):
    p = points(spark, d).withColumn("period", F.when(F.col("season") <= 15, "early").otherwise("late"))
    return r6(rel.membership_overlap(p, "period", "agency", list(AGENCIES), "sid"), "part_all")


@query("hitting_both", f"WITH {PTS}, c AS (SELECT sid, {COAST} AS coast FROM pts) SELECT sid FROM c GROUP BY sid HAVING count(*) FILTER (coast = 'Japan') > 0 AND count(*) FILTER (coast = 'Philippines') > 0")
def hitting_both(spark, d):
    return rel.hitting_both(coast_points(spark, d), "sid", F.col("coast") == "Japan", F.col("coast") == "Philippines")


@query("axis_of_maximum", f"WITH {FIELD}, a AS (SELECT * FROM fld WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY season, lon ORDER BY v DESC, lat) = 1), e AS (SELECT season, lon, avg(v) AS m FROM fld GROUP BY ALL) SELECT a.season, round(avg(a.lat), 6) AS axis_lat, (SELECT max(e.lon) FROM e WHERE e.season = a.season AND e.m > 0) AS east_lon FROM a GROUP BY a.season")
def axis_of_maximum(spark, d):
    return r6(fields.axis_of_maximum(field(spark, d), ["season"], "v"), "axis_lat")


@query("month_climatology", f"WITH {FIELD} SELECT (season % 6)::INT AS month, CASE WHEN season <= 15 THEN 'early' ELSE 'late' END AS period, lat, lon, round(avg(v), 6) AS mean FROM fld GROUP BY ALL")
def month_climatology(spark, d):
    f = field(spark, d).groupBy((F.col("season") % 6).alias("month"), F.when(F.col("season") <= 15, "early").otherwise("late").alias("period"), "lat", "lon")
    return r6(f.agg(F.avg("v").alias("mean")), "mean")


@query("field_deviation", f"WITH {FIELD}, s AS (SELECT lat, lon, stddev_pop(v) AS sd, avg(v) FILTER (season > 15) - avg(v) FILTER (season <= 15) AS delta FROM fld GROUP BY ALL) SELECT lat, lon, round(sd, 6) AS sd, round(delta / nullif(sd, 0), 5) AS ratio FROM s")
def field_deviation(spark, d):
    return fields.deviation(field(spark, d), ["lat", "lon"], "v", F.col("season") > 15).select("lat", "lon", F.round("sd", 6).alias("sd"), F.round("ratio", 5).alias("ratio"))


@query("absolute_percentile", f"WITH {PTS}, {DAILY}, d2 AS (SELECT lead(lat) OVER (ORDER BY season) - lat AS x FROM daily) SELECT round((sum((abs(x) <= 0.5)::INT) + 1) / (count(x) + 1), 6) AS percentile FROM d2")
def absolute_percentile(spark, d):
    s = rel.seam_differences(daily(spark, d), "season", "lat", 0)
    return r6(rel.absolute_percentile(F.lit(0.5), s, "difference"), "percentile")


@query("seam_differences", f"WITH {PTS}, {DAILY}, d2 AS (SELECT lead(season) OVER (ORDER BY season) AS to_season, lead(lat) OVER (ORDER BY season) - lat AS x FROM daily) SELECT to_season, round(x, 6) AS difference, to_season <> 16 AS reference FROM d2 WHERE x IS NOT NULL")
def seam_differences(spark, d):
    return r6(rel.seam_differences(daily(spark, d), "season", "lat", 16), "difference")


@query("match_summary", f"WITH {PTS}, m AS (SELECT agency, count(*) AS n, count(*) FILTER (wind >= 34) AS matched, count(*) FILTER (wind >= 34 AND season % 2 = 0) AS cross_year FROM pts GROUP BY agency) SELECT agency, n, matched, round(100.0::DOUBLE * matched / n, 6) AS percent, cross_year FROM m")
def match_summary(spark, d):
    hit = F.col("wind") >= 34
    m = points(spark, d).groupBy("agency").agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("matched"), F.count(F.when(hit & (F.col("season") % 2 == 0), 1)).alias("cross_year"))
    return r6(m.withColumn("percent", 100.0 * F.col("matched") / F.col("n")), "percent")


@query("row_shares", f"WITH {PTS}, c AS (SELECT season // 10 AS decade, {COAST} AS coast, count(*) AS n FROM pts GROUP BY ALL) SELECT decade::BIGINT AS decade, coast, round(n / sum(n) OVER (PARTITION BY decade), 9) AS share FROM c")
def row_shares(spark, d):
    n = coast_points(spark, d).groupBy(F.floor(F.col("season") / 10).alias("decade"), "coast").agg(F.count("*").alias("n"))
    return n.select("decade", "coast", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("decade")), 9).alias("share"))


@query("histogram", f"WITH {PTS}, b AS (SELECT min(wind) AS lo, max(wind) AS hi, median(wind) AS m FROM pts) SELECT least(29, floor((wind - lo) * 30 / (hi - lo)))::INT AS bin, count(*) AS n, round(max(m), 6) AS median FROM pts, b WHERE wind IS NOT NULL GROUP BY 1")
def histogram(spark, d):
    return r6(rel.histogram(points(spark, d), "wind", 30), "median")


@query("fdr_of_terms", f"WITH {PTS}, t AS (SELECT agency, nature AS term, round((avg(lat) - 15) / 10, 6) AS p FROM pts GROUP BY ALL), k AS (SELECT *, p * count(*) OVER (PARTITION BY agency) / row_number() OVER (PARTITION BY agency ORDER BY p, term) AS x FROM t WHERE term <> 'view'), q AS (SELECT agency, term, round(least(1.0::DOUBLE, min(x) OVER (PARTITION BY agency ORDER BY p, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k) SELECT t.agency, t.term, p, q FROM t LEFT JOIN q ON q.agency = t.agency AND q.term = t.term")
def fdr_of_terms(spark, d):
    t = points(spark, d).groupBy("agency", F.col("nature").alias("term")).agg(F.round((F.avg("lat") - 15) / 10, 6).alias("p"))
    t = t.withColumn("own", F.when(F.col("term") != "view", F.col("p")))
    return r6(inference.bh_fdr(t, "own", ["agency"]).drop("own"), "q")


@query("path_and_lifetime", f"WITH {TRK}, {seg('trk')}, s AS (SELECT sid, sum(dist_km) AS path_km FROM seg GROUP BY sid), l AS (SELECT sid, (epoch_us(max(iso_time)) - epoch_us(min(iso_time))) / 3.6e9::DOUBLE AS lifetime_h FROM trk GROUP BY sid HAVING count(*) >= 2) SELECT sid, round(lifetime_h, 6) AS lifetime_h, round(path_km, 5) AS path_km FROM l LEFT JOIN s USING (sid)")
def path_and_lifetime(spark, d):
    t = smooth(spark, d)
    life = t.groupBy("sid").agg(tracks.hours(F.min("iso_time"), F.max("iso_time")).alias("lifetime_h"), F.count("*").alias("n")).where("n >= 2")
    return life.join(tracks.mean_speed(t).select("sid", F.round("path_km", 5).alias("path_km")), "sid", "left").select("sid", F.round("lifetime_h", 6).alias("lifetime_h"), "path_km")


@query("strongest_thirty", f"WITH {PTS} SELECT event_id, wind FROM pts ORDER BY wind DESC NULLS LAST, iso_time, event_id LIMIT 30")
def strongest_thirty(spark, d):
    return points(spark, d).orderBy(F.desc_nulls_last("wind"), "iso_time", "event_id").limit(30).select("event_id", "wind")


@query("best_of_composite", f"WITH {PTS}, {YEARLY} SELECT agency, season, round(v, 6) AS v FROM yl QUALIFY row_number() OVER (ORDER BY v, -w, season, agency) = 1")
def best_of_composite(spark, d):
    best = yearly(spark, d).agg(F.min(F.struct("v", -F.col("w"), "season", "agency")).alias("b"))
    return best.select("b.agency", "b.season", F.round("b.v", 6).alias("v"))


@query("union_outer", f"WITH {PTS} SELECT kind, count(*) AS n, count(wind) AS n_wind, count(lat) AS n_lat FROM (SELECT 'a' AS kind, wind, NULL::DOUBLE AS lat FROM pts UNION ALL SELECT 'b', NULL, lat FROM pts) GROUP BY kind")
def union_outer(spark, d):
    p = points(spark, d)
    both = p.select(F.lit("a").alias("kind"), "wind").unionByName(p.select(F.lit("b").alias("kind"), "lat"), allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("wind").alias("n_wind"), F.count("lat").alias("n_lat"))


@query("common_entities", f"WITH {PTS} SELECT sid FROM pts WHERE agency = 'USA' INTERSECT SELECT sid FROM pts WHERE agency = 'TOKYO' INTERSECT SELECT sid FROM pts WHERE agency = 'CMA'")
def common_entities(spark, d):
    a, b, c = (points(spark, d).where(F.col("agency") == x).select("sid") for x in AGENCIES)
    return a.intersect(b).intersect(c)


@query("in_any_set", f"WITH {PTS} SELECT sid, count(*) AS n FROM pts WHERE sid IN (SELECT sid FROM pts WHERE wind >= 400 UNION SELECT sid FROM pts WHERE lat >= 39.9) GROUP BY sid")
def in_any_set(spark, d):
    p = points(spark, d)
    ids = p.where("wind >= 400").select("sid").union(p.where("lat >= 39.9").select("sid")).distinct()
    return p.join(ids, "sid", "left_semi").groupBy("sid").agg(F.count("*").alias("n"))


@query("share_columns", f"WITH {PTS} SELECT season, round(avg((lat >= 20)::INT), 6) AS north, round(1 - avg((lat >= 20)::INT), 6) AS south FROM pts GROUP BY season")
def share_columns(spark, d):
    s = points(spark, d).groupBy("season").agg(F.avg((F.col("lat") >= 20).cast("int")).alias("s")).withColumn("both", F.array("s", 1 - F.col("s")))
    return s.select("season", F.round(F.col("both")[0], 6).alias("north"), F.round(F.col("both")[1], 6).alias("south"))


@query("signed_projection", f"WITH {PTS}, {MEANS}, ec AS (SELECT season, sid, cell_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY season) AS w FROM (SELECT DISTINCT season, sid, cell_id FROM cells)), oc AS (SELECT cell_id, coalesce(sum(w) FILTER (season <= 15), 0) / (SELECT any_value(ne) FROM ny) AS early, coalesce(sum(w) FILTER (season > 15), 0) / (SELECT any_value(nl) FROM ny) AS late FROM ec GROUP BY cell_id) SELECT round(sum((oc.late - oc.early) * (means.late - means.early)) / sum((means.late - means.early) ** 2), 6) AS projection, round(corr(oc.late - oc.early, means.late - means.early), 6) AS r FROM means JOIN oc USING (cell_id)")
def signed_projection(spark, d):
    from ..operators.contrast import signed_projection as project

    p = points(spark, d)
    change = lambda kind: density.period_means(density.composition(p, kind), EARLY, LATE).select("cell_id", (F.col("late") - F.col("early")).alias("d"))
    return r6(project(change("occupancy"), change("point")), "projection", "r")


@query("coverage_gaps", f"WITH {PTS} SELECT agency, season FROM (SELECT unnest(['USA', 'TOKYO', 'CMA']) AS agency) CROSS JOIN (SELECT unnest(range(1, 41))::INT AS season) EXCEPT SELECT agency, season FROM pts")
def coverage_gaps(spark, d):
    years = spark.range(1, 41).select(F.col("id").cast("int").alias("season"))
    spine = spark.createDataFrame([(a,) for a in AGENCIES], "agency string").crossJoin(years)
    return rel.coverage_gaps(points(spark, d), spine, ["agency", "season"])


@query("interval_signs", f"WITH {PTS}, {YEARLY}, e AS (SELECT agency, season, 'v' AS metric, v - 20 AS value FROM yl UNION ALL SELECT agency, season, 'w', w - 100 FROM yl) SELECT agency, metric, CASE WHEN value - 1 > 0 THEN 'positive' WHEN value + 1 < 0 THEN 'negative' ELSE 'overlaps_zero' END AS sign, count(*) AS n FROM e GROUP BY ALL")
def interval_signs(spark, d):
    y = yearly(spark, d).select("agency", "season", (F.col("v") - 20).alias("v"), (F.col("w") - 100).alias("w")).unpivot(["agency", "season"], ["v", "w"], "metric", "value")
    return y.groupBy("agency", "metric", rel.interval_sign(F.col("value") - 1, F.col("value") + 1).alias("sign")).agg(F.count("*").alias("n"))


@query("sum_closure", f"WITH {PTS}, {YEARLY}, s AS (SELECT season, sum(n)::BIGINT AS total FROM yl GROUP BY season), w AS (SELECT season, count(*) + (season = 3)::INT AS whole FROM pts GROUP BY season) SELECT season, total, whole, abs(total - whole) <= 0 AS closes FROM s FULL JOIN w USING (season)")
def sum_closure(spark, d):
    whole = points(spark, d).groupBy("season").agg((F.count("*") + (F.first("season") == 3).cast("int")).alias("n"))
    return rel.sum_closure(yearly(spark, d), whole, ["season"], "n", 0)


@query("quality_checks", f"WITH {PTS}, {SHARES}, s AS (SELECT max(abs(t - 1)) AS v FROM (SELECT sum(share) AS t FROM shares GROUP BY season)), k AS (SELECT count(*) - count(DISTINCT event_id) AS v FROM pts) SELECT 'rows' AS name, count(*) > 0 AS passed, count(*)::DOUBLE AS value FROM pts UNION ALL SELECT 'unique_events', v = 0, v::DOUBLE FROM k UNION ALL SELECT 'no_null_wind', count(*) = 0, count(*)::DOUBLE FROM pts WHERE wind IS NULL UNION ALL SELECT 'shares_sum_to_one', v < 1e-9, round(v, 6) FROM s")
def quality_checks(spark, d):
    p = points(spark, d)
    sums = density.composition(p, "point").groupBy("season").agg(F.abs(F.sum("share") - 1).alias("t")).agg(F.round(F.max("t"), 6).alias("value"))
    return rel.checks(
        ("rows", p.agg(F.count("*").alias("value")), F.col("value") > 0), ("unique_events", p.agg((F.count("*") - F.countDistinct("event_id")).alias("value")), F.col("value") == 0),
        ("no_null_wind", p.agg(F.count(F.when(F.col("wind").isNull(), 1)).alias("value")), F.col("value") == 0), ("shares_sum_to_one", sums, F.col("value") < 1e-9),
    )


@query("registry_upsert", f"WITH {PTS}, {YEARLY}, old AS (SELECT season, round(v, 6) AS v FROM yl WHERE agency = 'USA'), new AS (SELECT season, round(w, 6) AS v FROM yl WHERE agency = 'CMA' AND season > 20) SELECT * FROM old WHERE season NOT IN (SELECT season FROM new) UNION ALL SELECT * FROM new")
def registry_upsert(spark, d):
    y = yearly(spark, d)
    return rel.upsert(y.where("agency = 'USA'").select("season", F.round("v", 6).alias("v")), y.where("agency = 'CMA' AND season > 20").select("season", F.round("w", 6).alias("v")), "season")


@query("nearest_point_km", f"WITH {PTS}, o AS (SELECT sid, event_id, {dist('lat', 'lon', 'lag(lat) OVER w', 'lag(lon) OVER w')} AS km FROM pts WINDOW w AS (PARTITION BY sid ORDER BY iso_time, event_id)) SELECT sid, round(max(km), 4) AS farthest FROM o GROUP BY sid")
def nearest_point_km(spark, d):
    from ..functions.geo import great_circle_km

    w = tracks.in_order()
    km = great_circle_km(F.col("lat"), F.col("lon"), F.lag("lat").over(w), F.lag("lon").over(w))
    return points(spark, d).withColumn("km", km).groupBy("sid").agg(F.round(F.max("km"), 4).alias("farthest"))
