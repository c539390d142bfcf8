"""Named queries of resampling tests, regressions and exact crossings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import sql_simpson
from ..operators import contrast, density, fields, inference, packed, spatial, tracks
from ..sources.adapters import points
from ..sources.adapters import tracks as smooth
from .registry import BLOCKS, DAILY, FIELD, PLACES, PTS, SHARES, SHUFFLES, STATE, TRK, blocks_of, daily, field, query, r6, seasons, seg

SHORT = 99
YL = "yl AS (SELECT agency, season, avg(lat) AS v, avg(wind) AS w, count(*) AS n FROM pts GROUP BY ALL)"
FULL = "ful AS (SELECT s.season, c.cell_id, coalesce(x.share, 0) AS share FROM (SELECT DISTINCT season FROM shares) s CROSS JOIN (SELECT DISTINCT cell_id FROM shares) c LEFT JOIN shares x ON x.season = s.season AND x.cell_id = c.cell_id)"
LOO = """sm AS (SELECT *, sum(share) FILTER (p = 'e') OVER k AS se, sum(share) FILTER (p = 'l') OVER k AS sl, count(*) FILTER (p = 'e') OVER k AS ne, count(*) FILTER (p = 'l') OVER k AS nl FROM lab WINDOW k AS (PARTITION BY rep, cell_id)),
mn AS (SELECT *, CASE WHEN p = 'e' THEN (se - share) / (ne - 1) ELSE se / ne END AS me, CASE WHEN p = 'l' THEN (sl - share) / (nl - 1) ELSE sl / nl END AS ml FROM sm),
sc AS (SELECT rep, season, p, 2 * sum((share - (ml + me) / 2) * (ml - me)) / sum((ml - me) ** 2) AS score FROM mn GROUP BY ALL)"""


def yearly(spark, d):
    return points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("v"), F.avg("wind").alias("w"), F.count("*").alias("n"))


def complete(shares):
    """Every cell of every year, absent ones 0: as many rows as years times cells of the grid."""
    return shares.select("season").distinct().crossJoin(shares.select("cell_id").distinct()).join(shares, ["season", "cell_id"], "left").na.fill({"share": 0.0})


@query("composition_test", f"WITH {PTS}, {SHARES}, {BLOCKS}, {PLACES}, n AS (SELECT count(*) AS n FROM blk), c AS (SELECT rep, cell_id, sum(CASE WHEN position >= 15 THEN share ELSE 0 END) / any_value(n - 15) - sum(CASE WHEN position < 15 THEN share ELSE 0 END) / 15 AS d FROM plc JOIN shares USING (season), n GROUP BY rep, cell_id), t AS (SELECT *, round(abs(d), 9) AS a, max(round(abs(d), 9)) OVER (PARTITION BY rep) AS m FROM c), o AS (SELECT cell_id, d AS change, a AS own FROM t WHERE rep = 0), p AS (SELECT cell_id, any_value(change) AS change, (sum((a >= own)::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE AS p, (sum((m >= own)::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE AS p_max FROM t JOIN o USING (cell_id) WHERE rep > 0 GROUP BY cell_id), k AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS x0, p * count(*) OVER () / (count(*) OVER (ORDER BY p)) AS x FROM p) SELECT cell_id, round(change, 7) AS change, round(p, 6) AS p, round(p_max, 6) AS p_max, round(least(1.0::DOUBLE, min(x) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k")
def composition_test(spark, d):
    out = inference.composition_test(density.composition(points(spark, d)), blocks_of(spark, d), 15, SHUFFLES, 11)
    return r6(out, "p", "p_max", "q").withColumn("change", F.round("change", 7))


@query("projection_left_out", f"WITH {PTS}, {SHARES}, {FULL}, lab AS (SELECT 0 AS rep, *, CASE WHEN season <= 15 THEN 'e' ELSE 'l' END AS p FROM ful), {LOO} SELECT season, round(score, 6) AS score FROM sc")
def projection_left_out(spark, d):
    full = complete(density.composition(points(spark, d))).withColumns({"rep": F.lit(0), "period": F.when(F.col("season") <= 15, "e").otherwise("l")})
    return r6(contrast.leave_one_out_scores(full).select("season", "score"), "score")


@query("projection_permutation", f"WITH {PTS}, {SHARES}, {FULL}, {BLOCKS}, {PLACES}, lab AS (SELECT rep, position, cell_id, season, share, CASE WHEN position < 15 THEN 'e' ELSE 'l' END AS p FROM plc JOIN ful USING (season)), {LOO}, r AS (SELECT rep, avg(score) FILTER (p = 'l') - avg(score) FILTER (p = 'e') AS d FROM sc GROUP BY rep), o AS (SELECT d AS observed FROM r WHERE rep = 0) SELECT round(max(observed), 6) AS separation, round((sum((round(abs(d), 7) >= round(abs(observed), 7))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM r, o WHERE rep > 0")
def projection_permutation(spark, d):
    out = packed.projection_permutation(density.composition(points(spark, d)), blocks_of(spark, d), 15, SHUFFLES, 11)
    return r6(out, "separation", "p_value")


@query("correlation_permutation", f"WITH {PTS}, {DAILY}, {BLOCKS}, {PLACES}, f AS (SELECT regr_slope(lat, season) AS a, regr_intercept(lat, season) AS b, regr_slope(wind, season) AS c, regr_intercept(wind, season) AS e FROM daily), s AS (SELECT season, lat - a * season - b AS dx, wind - c * season - e AS dy, row_number() OVER (ORDER BY season) - 1 AS position FROM daily, f), r AS (SELECT rep, corr(x.dx, y.dy) AS r FROM plc JOIN s x ON x.season = plc.season JOIN s y ON y.position = plc.position GROUP BY rep), o AS (SELECT r AS observed FROM r WHERE rep = 0), p AS (SELECT max(observed) AS r_detrended, (sum((round(abs(r), 9) >= round(abs(observed), 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE AS p_value FROM r, o WHERE rep > 0) SELECT round((SELECT corr(lat, wind) FROM daily), 6) AS r, (SELECT count(*) FROM daily) AS n, round(r_detrended, 6) AS r_detrended, round(p_value, 6) AS p_value FROM p")
def correlation_permutation(spark, d):
    return r6(inference.correlation_permutation(daily(spark, d), blocks_of(spark, d), "lat", "wind", SHUFFLES, 11), "r", "r_detrended", "p_value")


@query("stratified_labels", f"WITH {PTS}, {DAILY}, l AS (SELECT rep, season, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN lpad(season::VARCHAR, 8, '0') ELSE md5('7_' || rep || '_' || season) END, season) <= 15 AS early FROM (SELECT unnest(range({SHUFFLES + 1})) AS rep), daily), r AS (SELECT rep, avg(lat) FILTER (NOT early) - avg(lat) FILTER (early) AS d FROM l JOIN daily USING (season) GROUP BY rep), o AS (SELECT d AS observed FROM r WHERE rep = 0) SELECT round(max(observed), 6) AS difference, round((sum((round(abs(d), 9) >= round(abs(observed), 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM r, o WHERE rep > 0")
def stratified_labels(spark, d):
    s = daily(spark, d)
    r = inference.stratified_labels(seasons(spark, d), 15, SHUFFLES, 7).join(F.broadcast(s.select("season", "lat")), "season")  # a row a year
    r = r.groupBy("rep").agg((F.avg(F.when(~F.col("early"), F.col("lat"))) - F.avg(F.when(F.col("early"), F.col("lat")))).alias("d"))
    seen = r.where("rep = 0").select(F.col("d").alias("observed"))
    out = r.where("rep > 0").crossJoin(F.broadcast(seen)).agg(F.max("observed").alias("difference"), ((F.sum((F.round(F.abs("d"), 9) >= F.round(F.abs("observed"), 9)).cast("int")) + 1) / (SHUFFLES + 1.0)).alias("p_value"))
    return r6(out, "difference", "p_value")


@query("sen_bootstrap", f"WITH {PTS}, {YL}, s AS (SELECT a.agency, median((b.v - a.v) / (b.season - a.season)) AS slope FROM yl a JOIN yl b ON a.agency = b.agency AND a.season < b.season GROUP BY a.agency), m AS (SELECT agency, any_value(slope) AS slope, median(v - slope * season) AS base FROM yl JOIN s USING (agency) GROUP BY agency), f AS (SELECT agency, season, base + slope * season AS line, v - base - slope * season AS resid, row_number() OVER (PARTITION BY agency ORDER BY season) - 1 AS i, count(*) OVER (PARTITION BY agency) AS n FROM yl JOIN m USING (agency)), dr AS (SELECT f.*, rep, (('0x' || substr(md5('5_' || agency || '_' || rep || '_' || (i // 3)), 1, 8))::BIGINT % (n - 2) + i % 3) AS j FROM f, (SELECT unnest(range(1, {SHORT + 1})) AS rep)), x AS (SELECT dr.agency, rep, dr.season, dr.line + f.resid AS v FROM dr JOIN f ON f.agency = dr.agency AND f.i = dr.j), b AS (SELECT p.agency, p.rep, median((q.v - p.v) / (q.season - p.season)) AS slope FROM x p JOIN x q ON p.agency = q.agency AND p.rep = q.rep AND p.season < q.season GROUP BY ALL) SELECT agency, round(any_value(s.slope), 6) AS slope, round(quantile_cont(b.slope, 0.025), 6) AS low, round(quantile_cont(b.slope, 0.975), 6) AS high FROM b JOIN s USING (agency) GROUP BY agency")
def sen_bootstrap(spark, d):
    return r6(inference.sen_bootstrap(yearly(spark, d).select("agency", "season", "v"), ["agency"], "season", "v", 3, SHORT, 5), "slope", "low", "high")


EFFECTIVE = f"WITH {PTS}, {YL}, l AS (SELECT *, lag(v) OVER k AS v0, lag(w) OVER k AS w0 FROM yl WINDOW k AS (PARTITION BY agency ORDER BY season)), e AS (SELECT agency, corr(v, w) AS r, count(*) AS n, corr(v, v0) AS a, corr(w, w0) AS b FROM l GROUP BY agency), f AS (SELECT *, least(n::DOUBLE, greatest(3.0, n * (1 - a * b) / (1 + a * b))) AS n_eff FROM e)"


@query("effective_correlation", f"{EFFECTIVE} SELECT agency, round(r, 6) AS r, n, round(n_eff, 5) AS n_eff, round(r * sqrt((n_eff - 2) / (1 - r * r)), 5) AS t FROM f")
def effective_correlation(spark, d):
    out = inference.effective_correlation(yearly(spark, d), ["agency"], "season", "v", "w")
    return out.select("agency", F.round("r", 6).alias("r"), "n", F.round("n_eff", 5).alias("n_eff"), F.round("t", 5).alias("t"))


TAIL = "pow(sin(pi() / 2 * pow(@, 3)), df - 1) * pow(@, 2)"


@query("effective_correlation_p", f"{EFFECTIVE}, t AS (SELECT agency, r, n_eff, r * sqrt((n_eff - 2) / (1 - r * r)) AS t, greatest(n_eff - 2, 1.0::DOUBLE) AS df FROM f) SELECT agency, round(r, 6) AS r, round(n_eff, 5) AS n_eff, round(t, 5) AS t, round({sql_simpson(TAIL, 'pow(atan2(sqrt(df), abs(t)) / (pi() / 2), 1 / 3.0::DOUBLE)')} / {sql_simpson(TAIL, '1.0::DOUBLE')}, 6) AS p FROM t")
def effective_correlation_p(spark, d):
    out = inference.with_student_p(inference.effective_correlation(yearly(spark, d), ["agency"], "season", "v", "w"), ["agency"])
    return r6(out, "r", "p").withColumns({c: F.round(c, 5) for c in ("n_eff", "t")})


FIELD_R = f"""own AS (SELECT fld.lat, fld.lon, regr_slope(v, wind) AS beta, corr(v, wind) AS r FROM fld JOIN daily USING (season) GROUP BY fld.lat, fld.lon), pl AS (SELECT wind, row_number() OVER (ORDER BY season) - 1 AS position FROM daily),
tr AS (SELECT fld.lat, fld.lon, rep, corr(v, pl.wind) AS q FROM plc JOIN pl USING (position) JOIN fld USING (season) GROUP BY fld.lat, fld.lon, rep)"""


@query("field_regression", f"""WITH {FIELD}, {DAILY}, {BLOCKS}, {PLACES}, {FIELD_R}, p AS (SELECT tr.lat, tr.lon, any_value(beta) AS beta, any_value(r) AS r, (sum((round(abs(q), 9) >= round(abs(r), 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE AS p FROM tr JOIN own ON own.lat = tr.lat AND own.lon = tr.lon WHERE rep > 0 GROUP BY tr.lat, tr.lon),
k AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS x FROM p) SELECT lat, lon, round(beta, 6) AS beta, round(r, 6) AS r, round(p, 6) AS p, round(least(1.0::DOUBLE, min(x) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k""")
def field_regression(spark, d):
    cells, _ = packed.field_tests(field(spark, d), ["lat", "lon"], daily(spark, d), blocks_of(spark, d), "wind", "v", SHUFFLES, 11)
    return r6(cells, "beta", "r", "p", "q")


@query("field_global", f"WITH {FIELD}, {DAILY}, {BLOCKS}, {PLACES}, {FIELD_R}, g AS (SELECT rep, avg(q * q) AS r2 FROM tr GROUP BY rep), o AS (SELECT r2 AS seen FROM g WHERE rep = 0) SELECT round(max(seen), 7) AS global_r2, round((sum((round(r2, 9) >= round(seen, 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM g, o WHERE rep > 0")
def field_global(spark, d):
    _, whole = packed.field_tests(field(spark, d), ["lat", "lon"], daily(spark, d), blocks_of(spark, d), "wind", "v", SHUFFLES, 11)
    return r6(whole, "p_value").withColumn("global_r2", F.round("global_r2", 7))


AREA = f"""{FIELD}, {DAILY}, {BLOCKS}, {PLACES}, lab AS (SELECT row_number() OVER (ORDER BY season) - 1 AS position, CASE WHEN wind > m + s / 2 THEN 'one' WHEN wind < m - s / 2 THEN 'two' ELSE 'rest' END AS label FROM daily, (SELECT avg(wind) AS m, stddev_samp(wind) AS s FROM daily)),
cd AS (SELECT rep, lat, lon, round(avg(v) FILTER (label = 'one') - avg(v) FILTER (label = 'two'), 9) AS d FROM plc JOIN lab USING (position) JOIN fld USING (season) GROUP BY rep, lat, lon),
th AS (SELECT lat, lon, max(d) FILTER (rep = 0) AS difference, round(quantile_cont(d, 0.025) FILTER (rep > 0), 9) AS low, round(quantile_cont(d, 0.975) FILTER (rep > 0), 9) AS high FROM cd GROUP BY lat, lon)"""


def area_parts(spark, d):
    """Seasons of strong and of weak mean wind against each other."""
    series = daily(spark, d)
    limits = series.agg(F.avg("wind").alias("m"), F.stddev_samp("wind").alias("s"))
    labels = series.crossJoin(F.broadcast(limits)).select("season", F.when(F.col("wind") > F.col("m") + F.col("s") / 2, "one").when(F.col("wind") < F.col("m") - F.col("s") / 2, "two").otherwise("rest").alias("label"))
    return packed.area_significance(field(spark, d), ["lat", "lon"], "lat", labels, blocks_of(spark, d), "v", SHUFFLES, 11, "one", "two")


@query("composite_thresholds", f"WITH {AREA} SELECT lat, lon, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, coalesce(difference < low OR difference > high, false) AS outside FROM th")
def composite_thresholds(spark, d):
    return r6(area_parts(spark, d)[0], "difference", "low", "high")


@query("area_significance", f"WITH {AREA}, g AS (SELECT rep, coalesce(sum(cos(radians(cd.lat))) FILTER (d < low OR d > high), 0) AS area FROM cd JOIN th ON th.lat = cd.lat AND th.lon = cd.lon GROUP BY rep), o AS (SELECT area AS seen FROM g WHERE rep = 0) SELECT round(max(seen), 6) AS area, round((sum((round(area, 6) >= round(seen, 6))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM g, o WHERE rep > 0")
def area_significance(spark, d):
    return r6(area_parts(spark, d)[1], "area", "p_value")


TRIALS = 200


@query("null_calibration")
def null_calibration(spark, d):
    """Rejection rates of the projection tests on sets of the table's points whose seasons are dealt by a hash."""
    years = sorted(r.season for r in seasons(spark, d).collect())  # a row a year
    counts = packed.dealt_counts(density.with_cell(points(spark, d)), "event_id", years, TRIALS)
    total = counts.groupBy("trial", "season").agg(F.sum("n").alias("all"))
    shares = counts.join(total, ["trial", "season"]).select("trial", "season", "cell_id", (F.col("n") / F.col("all")).alias("share"))
    return packed.rejection_rates(packed.null_calibration(shares, blocks_of(spark, d), 15, 199, 72))


@query("cutpoint_sweep", f"WITH {PTS}, {YL}, c AS (SELECT unnest(range(11, 22))::INT AS cut) SELECT agency, cut, round(avg(v) FILTER (season >= cut) - avg(v) FILTER (season < cut), 6) AS shift FROM yl, c GROUP BY ALL")
def cutpoint_sweep(spark, d):
    cuts = yearly(spark, d).withColumn("cut", F.explode(F.sequence(F.lit(11), F.lit(21))))
    late = F.col("season") >= F.col("cut")
    return r6(cuts.groupBy("agency", "cut").agg((F.avg(F.when(late, F.col("v"))) - F.avg(F.when(~late, F.col("v")))).alias("shift")), "shift")


@query("cross_products", f"WITH {STATE} SELECT a.season AS year_w, b.season AS year_h, round(sum(a.w * b.h), 5) AS product FROM st a JOIN st b USING (cell_id) GROUP BY ALL")
def cross_products(spark, d):
    p = density.with_cell(points(spark, d)).groupBy("season", F.col("agency").alias("cell_id")).agg(F.count("*").alias("n"), F.avg("wind").alias("h"))
    from pyspark.sql import Window

    state = p.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("season")))
    return contrast.cross_products(state).withColumn("product", F.round("product", 5))


@query("shared_slope", f"WITH {TRK}, {seg('trk')}, v AS (SELECT dist_km, dt_h, lat2 - lat AS dy, lon2 - lon AS dx FROM seg) SELECT round((covar_pop(dy, dist_km) + covar_pop(dx, dt_h)) / (var_pop(dy) + var_pop(dx)), 6) AS alpha, round(avg(dist_km) - (covar_pop(dy, dist_km) + covar_pop(dx, dt_h)) / (var_pop(dy) + var_pop(dx)) * avg(dy), 5) AS beta1, round(avg(dt_h) - (covar_pop(dy, dist_km) + covar_pop(dx, dt_h)) / (var_pop(dy) + var_pop(dx)) * avg(dx), 5) AS beta2 FROM v")
def shared_slope(spark, d):
    s = tracks.segments(smooth(spark, d)).select("dist_km", "dt_h", (F.col("lat2") - F.col("lat")).alias("dy"), (F.col("lon2") - F.col("lon")).alias("dx"))
    out = inference.shared_slope(s, [("dy", "dist_km"), ("dx", "dt_h")])
    return out.select(F.round("alpha", 6).alias("alpha"), F.round("beta1", 5).alias("beta1"), F.round("beta2", 5).alias("beta2"))


@query("weighted_trend", f"WITH {PTS}, {DAILY.replace('avg(wind) AS wind', 'avg(wind) AS wind, count(*) AS n')}, m AS (SELECT sum(n * season) / sum(n) AS mx, sum(n * lat) / sum(n) AS my FROM daily), s AS (SELECT sum(n * (season - mx) * (lat - my)) / sum(n * (season - mx) ** 2) AS b, any_value(mx) AS mx, any_value(my) AS my FROM daily, m) SELECT 'const' AS term, round(my - b * mx, 5) AS coef FROM s UNION ALL SELECT 'season', round(b, 5) FROM s")
def weighted_trend(spark, d):
    s = points(spark, d).groupBy("season").agg(F.avg("lat").alias("lat"), F.count("*").alias("n"))
    return inference.ols(s, "lat", ["season"], "n").withColumn("coef", F.round("coef", 5))


GRID = "grd AS (SELECT r.r::INT AS row, c.c::INT AS col, ((r.r * 37 + c.c * 11) % 17)::DOUBLE AS g FROM (SELECT unnest(range(8)) AS r) r, (SELECT unnest(range(16)) AS c) c)"


@query("bilinear", f"WITH {PTS}, {GRID}, p AS (SELECT event_id, floor((lon - 102.5) / 5)::INT AS c0, floor((lat - 2.5) / 5)::INT AS r0, (lon - 102.5) / 5 - floor((lon - 102.5) / 5) AS fx, (lat - 2.5) / 5 - floor((lat - 2.5) / 5) AS fy FROM pts) SELECT event_id, round((a.g * (1 - fx) + b.g * fx) * (1 - fy) + (c.g * (1 - fx) + e.g * fx) * fy, 6) AS interpolated FROM p LEFT JOIN grd a ON a.row = r0 AND a.col = c0 LEFT JOIN grd b ON b.row = r0 AND b.col = c0 + 1 LEFT JOIN grd c ON c.row = r0 + 1 AND c.col = c0 LEFT JOIN grd e ON e.row = r0 + 1 AND e.col = c0 + 1")
def bilinear(spark, d):
    grid = spark.range(128).select(F.floor(F.col("id") / 16).cast("int").alias("row"), (F.col("id") % 16).cast("int").alias("col"))
    grid = grid.withColumn("g", ((F.col("row") * 37 + F.col("col") * 11) % 17).cast("double"))
    return r6(fields.bilinear(points(spark, d).select("event_id", "lat", "lon"), grid, 102.5, 2.5, 5.0, "g").select("event_id", "interpolated"), "interpolated")


#: Two islands, counterclockwise: a triangle and a square.
ISLES = [(0, 120.0, 10.0, 140.0, 12.0), (1, 140.0, 12.0, 128.0, 25.0), (2, 128.0, 25.0, 120.0, 10.0), (3, 150.0, 15.0, 160.0, 15.0), (4, 160.0, 15.0, 160.0, 30.0), (5, 160.0, 30.0, 150.0, 30.0), (6, 150.0, 30.0, 150.0, 15.0)]
EDGES = f"edg AS (SELECT * FROM (VALUES {', '.join(map(str, ISLES))}) e(edge_id, x1, y1, x2, y2))"


@query("edge_crossings", f"WITH {TRK}, {seg('trk')}, {EDGES}, t AS (SELECT sid, event_id, edge_id, lat, lon, (lon2 - lon)::DOUBLE AS dx, (lat2 - lat)::DOUBLE AS dy, (x2 - x1)::DOUBLE AS ex, (y2 - y1)::DOUBLE AS ey, (x1 - lon)::DOUBLE AS ox, (y1 - lat)::DOUBLE AS oy FROM seg, edg), u AS (SELECT *, (ox * ey - oy * ex) / (dx * ey - dy * ex) AS f, (ox * dy - oy * dx) / (dx * ey - dy * ex) AS g FROM t WHERE dx * ey - dy * ex < 0) SELECT sid, event_id, edge_id, round(lat + f * dy, 5) AS lat, round(lon + f * dx, 5) AS lon FROM u WHERE f BETWEEN 0 AND 1 AND g >= 0 AND g < 1 QUALIFY row_number() OVER (PARTITION BY sid, event_id ORDER BY round(f, 8), edge_id) = 1")
def edge_crossings(spark, d):
    edges = spark.createDataFrame([(i, *map(float, e)) for i, *e in ISLES], "edge_id int, x1 double, y1 double, x2 double, y2 double")
    found = spatial.first_entries(spatial.edge_crossings(tracks.segments(smooth(spark, d)), edges))
    return found.select("sid", "event_id", "edge_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
