"""Named queries of decompositions and contrasts under many scenarios, of composites by group and of table sinks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scratch import folder_for
from ..operators import density, fields, resampled, sensitivity
from ..sources import readers, sinks
from ..sources.adapters import AGENCIES, points
from .registry import CELLS, COAST, FIELD, PTS, SHUFFLES, field, query, r6
from .resampled import DRAWS, JOINT, OWN, spans, tidy

MEMBERS = "mb AS (SELECT season, sid, agency, count(*) / sum(count(*)) OVER (PARTITION BY season, sid)::DOUBLE AS m FROM pts GROUP BY season, sid, agency)"
MOMENTS = f"""{PTS}, {MEMBERS}, ev AS (SELECT season, sid, arg_min(lat, (iso_time, event_id)) AS lat FROM (SELECT *, {COAST} AS coast FROM pts) WHERE coast <> 'Other' GROUP BY ALL),
ne AS (SELECT season, count(*) AS n FROM ev GROUP BY season), mo AS (SELECT season, agency, sum(m) / any_value(n) AS pi, sum(m * lat) / any_value(n) AS moment FROM ev JOIN mb USING (season, sid) JOIN ne USING (season) GROUP BY season, agency)"""
SPLIT_MOMENTS = """g AS (SELECT *, qe / pe AS mu_early, ql / pl AS mu_late, (pl - pe) * (ql / pl + qe / pe) / 2 AS between, (pl + pe) / 2 * (ql / pl - qe / pe) AS within, ql - qe AS change FROM s)"""
OBSERVED = "ny AS (SELECT count(DISTINCT season) FILTER (season <= 15) AS ke, count(DISTINCT season) FILTER (season > 15) AS kl FROM mo), s AS (SELECT agency, sum(pi) FILTER (season <= 15) / any_value(ke) AS pe, sum(pi) FILTER (season > 15) / any_value(kl) AS pl, sum(moment) FILTER (season <= 15) / any_value(ke) AS qe, sum(moment) FILTER (season > 15) / any_value(kl) AS ql FROM mo, ny GROUP BY agency)"


def members(spark, d):
    """An entity's membership in agencies: the parts of its points of a season."""
    p = points(spark, d).groupBy("season", "sid", "agency").agg(F.count("*").alias("n"))
    return p.withColumn("m", F.col("n") / F.sum("n").over(Window.partitionBy("season", "sid"))).drop("n")


def moments(spark, d, draws: int):
    """Moments of the latitude of an entity's first point of a season in a coast box, under ``draws`` draws of years and the observed ones."""
    p = points(spark, d).withColumn("coast", geo.classify_boxes(F.col("lat"), F.col("lon"))).where("coast <> 'Other'")
    events = p.groupBy("season", "sid").agg(F.min_by("lat", F.struct("iso_time", "event_id")).alias("lat"))
    rows = sensitivity.group_moments(events, members(spark, d), "agency", "lat")
    years = rows.select("season").distinct().select("season", F.when(F.col("season") <= 15, "e").otherwise("l").alias("period"))
    return sensitivity.moment_groups(rows, resampled.year_weights(years, 3, draws, 5, circular=False), "agency")


@query("moment_groups", f"WITH {MOMENTS}, {OBSERVED}, {SPLIT_MOMENTS} SELECT agency, round(pe, 6) AS pi_early, round(pl, 6) AS pi_late, round(mu_early, 6) AS mu_early, round(mu_late, 6) AS mu_late, round(between, 6) AS between, round(within, 6) AS within, round(change, 6) AS change FROM g")
def moment_groups(spark, d):
    return r6(moments(spark, d, 0), "pi_early", "pi_late", "mu_early", "mu_late", "between", "within", "change").drop("rep", "moment_early", "moment_late")


@query("moment_decomposition", f"WITH {MOMENTS}, {OBSERVED}, {SPLIT_MOMENTS} SELECT round(sum(qe), 6) AS mean_early, round(sum(ql), 6) AS mean_late, round(sum(change), 6) AS change, round(sum(between), 6) AS between, round(sum(within), 6) AS within, round(abs(sum(change) - sum(between) - sum(within)), 6) AS closure_abs FROM g")
def moment_decomposition(spark, d):
    return r6(sensitivity.moment_change(moments(spark, d, 0)), "mean_early", "mean_late", "change", "between", "within", "closure_abs").drop("rep")


@query("moment_bootstrap", f"WITH {MOMENTS}, {OWN}, s AS (SELECT rep, agency, sum(we * pi) AS pe, sum(wl * pi) AS pl, sum(we * moment) AS qe, sum(wl * moment) AS ql FROM mo JOIN wy USING (season) GROUP BY ALL), {SPLIT_MOMENTS}, r AS (SELECT rep, sum(change) AS change, sum(between) AS between, sum(within) AS within FROM g GROUP BY rep) {spans('r', ['change', 'between', 'within'])}")
def moment_bootstrap(spark, d):
    return tidy(sensitivity.moment_bootstrap(moments(spark, d, DRAWS)))


PERIODS = [(f"{start}-{cut}", start, cut, 30) for start in (1, 4, 7) for cut in range(13, 20, 2)]
SHARES_OF = "t AS (SELECT {by}, cell_id, sum((pl - pe) * (je / pe + jl / pl) / 2) AS b, sum((pe + pl) / 2 * (jl / pl - je / pe)) AS w, sum(jl - je) AS d FROM p GROUP BY ALL)"
PARTS = "round(sum(b * d) / sum(d * d), 6) AS between_share, round(sum(w * d) / sum(d * d), 6) AS within_share, round(sum(abs(d)) / 2, 6) AS total_variation, round(max(abs(d - b - w)), 6) AS closure_max_abs"


@query("period_sensitivity", f"""WITH {JOINT}, c AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {b}, {e})" for n, a, b, e in PERIODS)}) AS v(scenario, start, cutpoint, "end")),
m AS (SELECT scenario, start, cutpoint, "end", agency, cell_id, coalesce(sum(share) FILTER (season >= start AND season < cutpoint), 0) / any_value(cutpoint - start) AS je, coalesce(sum(share) FILTER (season >= cutpoint AND season <= "end"), 0) / any_value("end" - cutpoint + 1) AS jl FROM j, c GROUP BY ALL),
p AS (SELECT *, sum(je) OVER (PARTITION BY scenario, agency) AS pe, sum(jl) OVER (PARTITION BY scenario, agency) AS pl FROM m), {SHARES_OF.format(by='scenario, start, cutpoint, "end"')}
SELECT scenario, start, cutpoint, "end", cutpoint - start AS n_early, "end" - cutpoint + 1 AS n_late, {PARTS} FROM t GROUP BY ALL""")
def period_sensitivity(spark, d):
    p = density.with_cell(points(spark, d)).groupBy("season", "agency", "cell_id").agg(F.count("*").alias("n"))
    joint = p.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("season"))).drop("n")
    out = sensitivity.period_sensitivity(joint, sensitivity.period_weights(joint, PERIODS), "agency")
    return r6(out, "between_share", "within_share", "total_variation", "closure_max_abs")


#: (mode, box of west, east, south and north, cell width, fixed denominator)
DOMAINS = [("primary", (100.0, 180.0, 0.0, 40.0), 5.0, False), ("tropics", (100.0, 180.0, 0.0, 30.0), 5.0, False), ("west", (100.0, 150.0, 0.0, 40.0), 5.0, False), ("west_fixed", (100.0, 150.0, 0.0, 40.0), 5.0, True)]


def sql_bin(x: str, low: float, high: float, width: float) -> str:
    return f"(CASE WHEN {x} = {high} THEN {int((high - low) / width) - 1} ELSE floor(({x} - {low}) / {width}::DOUBLE)::INT END)"


def sql_cell(box: tuple, width: float) -> str:
    west, east, south, north = box
    return f"{sql_bin('lat', south, north, width)} * {int((east - west) / width)} + {sql_bin('lon', west, east, width)}"


def sql_inside(box: tuple) -> str:
    return f"lat BETWEEN {box[2]} AND {box[3]} AND lon BETWEEN {box[0]} AND {box[1]}"


ENTITIES = ", ".join([PTS, MEMBERS, "al AS (" + " UNION ALL ".join(f"SELECT '{mode}' AS mode, {fixed} AS fixed, season, sid, CASE WHEN {sql_inside(box)} THEN {sql_cell(box, width)} END AS cell_id FROM pts" for mode, box, width, fixed in DOMAINS) + ")", "en AS (SELECT mode, fixed, season, sid, count(cell_id) AS inside, count(*) AS total FROM al GROUP BY ALL), vd AS (SELECT * FROM en WHERE fixed OR inside > 0)"])


@query("domain_sensitivity", f"""WITH {ENTITIES}, sh AS (SELECT mode, season, sid, cell_id, count(*) / CASE WHEN any_value(fixed) THEN any_value(total) ELSE any_value(inside) END::DOUBLE AS share FROM al JOIN vd USING (mode, fixed, season, sid) WHERE cell_id IS NOT NULL GROUP BY mode, season, sid, cell_id),
yn AS (SELECT mode, season, season <= 15 AS e, count(*) AS n FROM vd GROUP BY ALL), yw AS (SELECT mode, season, e, 1.0::DOUBLE / (n * count(*) OVER (PARTITION BY mode, e)) AS w FROM yn),
pi AS (SELECT mode, agency, coalesce(sum(m * w) FILTER (e), 0) AS pe, coalesce(sum(m * w) FILTER (NOT e), 0) AS pl FROM vd JOIN mb USING (season, sid) JOIN yw USING (mode, season) GROUP BY ALL),
jt AS (SELECT mode, agency, cell_id, coalesce(sum(share * m * w) FILTER (e), 0) AS je, coalesce(sum(share * m * w) FILTER (NOT e), 0) AS jl FROM sh JOIN mb USING (season, sid) JOIN yw USING (mode, season) GROUP BY ALL), p AS (SELECT * FROM jt JOIN pi USING (mode, agency)),
{SHARES_OF.format(by='mode')}, q AS (SELECT mode, {PARTS} FROM t GROUP BY mode), ms AS (SELECT mode, round(sum(je), 6) AS mass_early, round(sum(jl), 6) AS mass_late FROM jt GROUP BY mode),
hd AS (SELECT mode, round(avg((fixed OR inside > 0)::INT), 6) AS valid_fraction, round(sum(inside) / sum(total)::DOUBLE, 6) AS coverage FROM en GROUP BY mode) SELECT * FROM hd JOIN ms USING (mode) JOIN q USING (mode)""")
def domain_sensitivity(spark, d):
    out = sensitivity.domain_sensitivity(points(spark, d), members(spark, d), DOMAINS, "agency", (1, 15), (16, 31))
    return r6(out, *[c for c in out.columns if c != "mode"])


@query("domain_null")
def domain_null(spark, d):
    """Whether each domain's change goes between the agencies of entities' first points more than labels dealt at random have it."""
    labels = points(spark, d).groupBy("season", "sid").agg(F.min_by("agency", F.struct("iso_time", "event_id")).alias("label")).withColumn("period", F.when(F.col("season") <= 15, "e").otherwise("l"))
    return sensitivity.domain_null(points(spark, d), labels, DOMAINS, SHUFFLES, 3)


BOX = (100.0, 180.0, 0.0, 40.0)
#: (field, SQL of its points, cell width)
SELECTIONS = [("primary", "true", 5.0), ("primary_fine", "true", 2.5), ("primary_coarse", "true", 10.0), *[(a.lower(), f"agency = '{a}'", 5.0) for a in AGENCIES], ("strong", "wind >= 64", 5.0)]
GRID = {name: int(80 / width) * int(40 / width) for name, _, width in SELECTIONS}
CATALOGS = ["primary", *[a.lower() for a in AGENCIES]]
#: (analysis, early, late): other ends of equal periods
ENDPOINTS = [("end_29_drop_15", (1, 14), (16, 29)), ("start_2_drop_16", (2, 15), (17, 30)), ("end_28", (1, 14), (15, 28))]


def design() -> list[dict]:
    """106 configurations: grid and blocks, catalogs, end points, left-out spans of years, strong points only."""
    out = []

    def put(analysis, name, block=3, early=(1, 15), late=(16, 30), without=None, against=None):
        for weighting in ("point", "entity"):
            out.append({"analysis": analysis, "field": name, "weighting": weighting, "block": block, "early": early, "late": late, "without": without, "against": against, "cells": GRID[name]})

    for name in ("primary_fine", "primary", "primary_coarse"):
        put("grid_primary", name)
        for block in (2, 4, 5):
            put("block_sensitivity", name, block, against="grid_primary")
    for name in CATALOGS:
        put("cross_agency_primary", name)
    for analysis, early, late in ENDPOINTS:
        for name in CATALOGS:
            put(analysis, name, early=early, late=late, against="cross_agency_primary")
    for first in range(1, 31, 5):
        for name in CATALOGS:
            put(f"drop_{first}_{first + 4}", name, without=range(first, first + 5), against="cross_agency_primary")
    put("strong_threshold", "strong")
    return out


DESIGN = design()
VALUES = ", ".join(f"({i}, '{c['analysis']}', '{c['field']}', '{c['weighting']}', {c['block']}, {c['early'][0]}, {c['early'][1]}, {c['late'][0]}, {c['late'][1]}, {repr(c['against']) if c['against'] else 'NULL'}, {c['cells']}, {list(c['without'] or [])}::INT[])" for i, c in enumerate(DESIGN))


def shares_of(spark, d):
    return sensitivity.field_shares(points(spark, d), [(name, F.expr(where), width) for name, where, width in SELECTIONS], BOX)


@query("robustness_observed", f"""WITH {PTS}, raw AS ({' UNION ALL '.join(f"SELECT '{name}' AS field, season, sid, {sql_cell(BOX, width)} AS cell_id FROM pts WHERE {where} AND {sql_inside(BOX)}" for name, where, width in SELECTIONS)}),
cn AS (SELECT field, season, sid, cell_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY field, season, sid)::DOUBLE AS own FROM raw GROUP BY field, season, sid, cell_id),
ms AS (SELECT field, 'point' AS weighting, season, cell_id, sum(n)::DOUBLE AS mass FROM cn GROUP BY ALL UNION ALL SELECT field, 'entity', season, cell_id, sum(n / own) FROM cn GROUP BY ALL),
sh AS (SELECT *, mass / sum(mass) OVER (PARTITION BY field, weighting, season) AS share FROM ms), yr AS (SELECT DISTINCT season FROM sh),
ds AS (SELECT * FROM (VALUES {VALUES}) AS v(config, analysis, field, weighting, block, early_start, early_end, late_start, late_end, against, cells, without)),
cy AS (SELECT *, count(*) OVER (PARTITION BY config, early) AS n FROM (SELECT config, season, season BETWEEN early_start AND early_end AS early FROM ds, yr WHERE NOT list_contains(without, season) AND (season BETWEEN early_start AND early_end OR season BETWEEN late_start AND late_end))),
ne AS (SELECT config, count(*) FILTER (early) AS n_early, count(*) FILTER (NOT early) AS n_late FROM cy GROUP BY config),
ch AS (SELECT config, analysis, field, weighting, against, cells, cell_id, sum(CASE WHEN early THEN -share ELSE share END / n) AS d FROM ds JOIN cy USING (config) JOIN sh USING (field, weighting, season) GROUP BY ALL),
tv AS (SELECT config, sum(abs(d)) / 2 AS tv, sum(d) AS x, sum(d * d) AS xx FROM ch GROUP BY config),
xy AS (SELECT a.config, b.config AS base, sum(a.d * b.d) AS xy FROM ch a JOIN ch b ON b.analysis = a.against AND b.field = a.field AND b.weighting = a.weighting AND b.cell_id = a.cell_id GROUP BY ALL),
co AS (SELECT xy.config, s.xx * cells - s.x ** 2 AS sx, b.xx * cells - b.x ** 2 AS sy, cells * xy - s.x * b.x AS num FROM xy JOIN ds USING (config) JOIN tv s USING (config) JOIN tv b ON b.config = base)
SELECT config, analysis, field, weighting, block, early_start, early_end, late_start, late_end, n_early, n_late, against, cells, round(tv, 6) AS tv, CASE WHEN sx * sy > 0 THEN round(num / sqrt(sx * sy), 6) END AS corr FROM ds JOIN ne USING (config) JOIN tv USING (config) LEFT JOIN co USING (config)""")
def robustness_observed(spark, d):
    return r6(sensitivity.observed_contrasts(shares_of(spark, d), DESIGN), "tv", "corr")


@query("robustness_matrix")
def robustness_matrix(spark, d):
    return r6(sensitivity.robustness_matrix(shares_of(spark, d), DESIGN, SHUFFLES, 11), "tv", "corr", "p_value")


@query("group_composites", f"WITH {FIELD}, fm AS (SELECT season, sid, arg_min(agency, (iso_time, event_id)) AS family, arg_min(lat, (iso_time, event_id)) AS start FROM pts GROUP BY ALL), tm AS (SELECT DISTINCT family, season FROM fm WHERE start >= 20) SELECT family, lat, lon, count(*) AS n_times, round(avg(v), 6) AS v FROM fld JOIN tm USING (season) GROUP BY ALL")
def group_composites(spark, d):
    """Fields over the seasons in which a family has entities that start in the north."""
    first = F.struct("iso_time", "event_id")
    p = points(spark, d).groupBy("season", "sid").agg(F.min_by("agency", first).alias("family"), F.min_by("lat", first).alias("start")).where("start >= 20")
    return r6(sensitivity.group_composites(p, field(spark, d), "family", ["lat", "lon"], ["v"]), "v")


@query("phase_difference", f"WITH {PTS}, {CELLS}, py AS (SELECT season, avg(wind) AS w FROM pts GROUP BY season), ph AS (SELECT season, CASE ntile(3) OVER (ORDER BY w, season) WHEN 1 THEN 'low' WHEN 2 THEN 'mid' ELSE 'high' END AS phase FROM py), ct AS (SELECT phase, season, cell_id, count(*) AS n FROM cells JOIN ph USING (season) GROUP BY ALL), ys AS (SELECT count(*) FILTER (phase = 'high') AS kh, count(*) FILTER (phase = 'low') AS kl FROM ph) SELECT cell_id, round(coalesce(sum(n) FILTER (phase = 'high'), 0) / any_value(kh)::DOUBLE - coalesce(sum(n) FILTER (phase = 'low'), 0) / any_value(kl)::DOUBLE, 6) AS difference FROM ct, ys GROUP BY cell_id")
def phase_difference(spark, d):
    """Points a year and cell in the windiest third of seasons less those in the calmest; absent cells are 0."""
    phase = F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.ntile(3).over(Window.orderBy("w", "season")))  # a row a season
    years = points(spark, d).groupBy("season").agg(F.avg("wind").alias("w")).select("season", phase.alias("phase"))
    cells = density.with_cell(points(spark, d))
    full = density.spine([years, cells.select("cell_id").distinct()], cells.groupBy("season", "cell_id").agg(F.count("*").cast("double").alias("n")), ["season", "cell_id"], {"n": 0.0})
    return r6(fields.composite_difference(full, ["cell_id"], "n", "phase", "high", "low"), "difference")


def scratch(spark, name: str) -> str:
    return f"{folder_for(spark)}/isotrack-{uuid.uuid4().hex}/{name}"


@query("csv_points", f"WITH {PTS} SELECT event_id, sid, iso_time, agency, CASE WHEN event_id % 7 <> 0 THEN round(lat, 4) END AS lat, round(lon, 4) AS lon, round(wind, 4) AS wind FROM pts")
def csv_points(spark, d):
    """The points written as compressed CSV and read again by chosen columns; every seventh latitude is blank."""
    path = scratch(spark, "points.csv")
    p = points(spark, d).withColumns({c: F.round(c, 4) for c in ("lat", "lon", "wind")})
    out = p.select("event_id", "nature", "sid", "season", "agency", "iso_time", F.when(F.col("event_id") % 7 != 0, F.col("lat").cast("string")).otherwise(" ").alias("LAT"), F.col("lon").alias("LON"), F.col("wind").alias("USA_WIND"))
    sinks.write_csv(out, path, gzip=True)
    back = readers.read_points(spark, path, {"event_id": "event_id", "sid": "sid", "iso_time": "iso_time", "agency": "agency", "lat": "LAT", "lon": "LON", "wind": "USA_WIND"}, ["lat", "lon", "wind"])
    return back.withColumns({c: F.col(c).cast("long") for c in ("event_id", "sid")}).withColumn("lon", F.round("lon", 4))


@query("monthly_index", f"WITH {PTS}, mo AS (SELECT (1900 + sid % 100)::INT AS season, (season - 1) % 12 + 1 AS month, max(round(wind, 2)) AS v FROM pts GROUP BY ALL), wd AS (SELECT season, map_from_entries(list({{k: month, v: v}})) AS m FROM mo GROUP BY season) SELECT season, round((coalesce(m[7], -9.9::DOUBLE) + coalesce(m[8], -9.9::DOUBLE) + coalesce(m[9], -9.9::DOUBLE)) / 3, 6) AS jas FROM wd")
def monthly_index(spark, d):
    """A text table of a year and twelve values a line, and the mean of the seventh to ninth."""
    path = scratch(spark, "index.txt")
    v = points(spark, d).groupBy((F.lit(1900) + F.col("sid") % 100).alias("season"), ((F.col("season") - 1) % 12 + 1).alias("month")).agg(F.max(F.round("wind", 2)).alias("v"))
    held = v.groupBy("season").agg(F.map_from_entries(F.collect_list(F.struct("month", "v"))).alias("m"))  # twelve months
    value = lambda i: F.format_string("%.2f", F.coalesce(F.element_at("m", F.lit(i)), F.lit(-9.9)))
    held.select(F.concat_ws("  ", F.col("season").cast("string"), *[value(i) for i in range(1, 13)]).alias("value")).write.text(path)
    return r6(readers.read_monthly_index(spark, path, [7, 8, 9], "jas"), "jas")
