"""Named queries of bootstraps, label nulls and period effects, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import density, resampled
from ..sources.adapters import points
from .registry import BLOCKS, CELLS, PLACES, PTS, SHARES, SHUFFLES, STATE, blocks_of, query, r6, seasons

DRAWS = 999


def draws(place: str) -> str:
    """Weights of drawn years: (rep, period, season, w), replicate 0 as observed."""
    return f"""per AS (SELECT season, CASE WHEN season <= 15 THEN 'e' ELSE 'l' END AS period FROM (SELECT DISTINCT season FROM pts)),
hld AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY season) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM per),
drw AS (SELECT rep, period, n, i AS k, ('0x' || substr(md5('5_' || period || '_' || rep || '_' || (i // 3)), 1, 8))::BIGINT AS start FROM hld, (SELECT unnest(range({DRAWS + 1})) AS rep)),
wgt AS (SELECT rep, d.period, h.season, count(*) / any_value(d.n)::DOUBLE AS w FROM (SELECT *, CASE WHEN rep = 0 THEN k ELSE {place} END AS i FROM drw) d JOIN hld h ON h.period = d.period AND h.i = d.i GROUP BY ALL),
wy AS (SELECT rep, season, coalesce(sum(w) FILTER (period = 'e'), 0) AS we, coalesce(sum(w) FILTER (period = 'l'), 0) AS wl FROM wgt GROUP BY ALL)"""


CIRCULAR, OWN = draws("(start + k % 3) % n"), draws("start % (n // 3) * 3 + k % 3")


def spans(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS quantity, round(max({c}) FILTER (rep = 0), 6) + 0 AS observed, round(quantile_cont({c}, 0.025) FILTER (rep > 0), 6) + 0 AS low, round(quantile_cont({c}, 0.5) FILTER (rep > 0), 6) + 0 AS median, round(quantile_cont({c}, 0.975) FILTER (rep > 0), 6) + 0 AS high, count({c}) FILTER (rep > 0) AS n FROM {source}" for c in names)


def periods(spark, d):
    return seasons(spark, d).select("season", F.when(F.col("season") <= 15, "e").otherwise("l").alias("period"))


def tidy(df):
    return df.select("quantity", *[(F.round(c, 6) + 0.0).alias(c) for c in ("observed", "low", "median", "high")], "n")


@query("shapley_bootstrap", f"""WITH {PTS}, {CELLS}, {CIRCULAR}, e AS (SELECT sid, season, arg_min(floor(lat / 10)::BIGINT, (iso_time, event_id)) AS bin, count(*) AS n FROM cells GROUP BY ALL),
o AS (SELECT *, count(*) OVER (PARTITION BY season) AS ny FROM e), a AS (SELECT bin, cell_id, season, sum(1.0::DOUBLE / (n * ny)) AS a FROM cells JOIN o USING (sid, season) GROUP BY ALL),
b AS (SELECT bin, season, count(*) AS n, count(*) / any_value(ny)::DOUBLE AS s FROM o GROUP BY ALL),
h AS (SELECT rep, bin, sum(we * s) AS we, sum(wl * s) AS wl FROM b JOIN wy USING (season) GROUP BY ALL HAVING sum(n) FILTER (wy.we > 0) >= 3 AND sum(n) FILTER (wy.wl > 0) >= 3),
g AS (SELECT rep, bin, h.we, h.wl, sum(h.we) OVER (PARTITION BY rep) AS ce, sum(h.wl) OVER (PARTITION BY rep) AS cl FROM h),
s AS (SELECT g.rep, g.bin, cell_id, any_value(ce) AS ce, any_value(cl) AS cl, any_value(g.we / ce) AS ge, any_value(g.wl / cl) AS gl, sum(wy.we * a) / any_value(g.we) AS se, sum(wy.wl * a) / any_value(g.wl) AS sl FROM g JOIN a USING (bin) JOIN wy ON wy.rep = g.rep AND wy.season = a.season GROUP BY g.rep, g.bin, cell_id),
c AS (SELECT rep, cell_id, any_value(ce) AS ce, any_value(cl) AS cl, sum((gl - ge) * (se + sl) / 2) AS g, sum((ge + gl) / 2 * (sl - se)) AS p, sum(gl * sl - ge * se) AS t FROM s GROUP BY ALL),
r AS (SELECT rep, sum(abs(t)) / 2 AS total_tv, sum(g * t) / sum(t * t) AS genesis_fraction, sum(p * t) / sum(t * t) AS propagation_fraction, any_value(ce) AS early_coverage, any_value(cl) AS late_coverage FROM c GROUP BY rep)
{spans("r", ["total_tv", "genesis_fraction", "propagation_fraction", "early_coverage", "late_coverage"])}""")
def shapley_bootstrap(spark, d):
    p = density.with_cell(points(spark, d)).withColumn("start", F.floor(F.col("lat") / 10))
    return tidy(resampled.shapley_bootstrap(p, resampled.year_weights(periods(spark, d), 3, DRAWS, 5), "start"))


JOINT = f"{PTS}, {CELLS}, j AS (SELECT season, agency, cell_id, count(*) / sum(count(*)) OVER (PARTITION BY season)::DOUBLE AS share FROM cells GROUP BY season, agency, cell_id)"
SPLIT = """t AS (SELECT rep, cell_id, sum((pl - pe) * (je / pe + jl / pl) / 2) AS b, sum((pe + pl) / 2 * (jl / pl - je / pe)) AS w, sum(jl - je) AS d FROM p GROUP BY ALL),
r AS (SELECT rep, sum(b * d) / sum(d * d) AS between_share, sum(w * d) / sum(d * d) AS within_share, sum(abs(d)) / 2 AS total_variation FROM t GROUP BY rep)"""


@query("between_bootstrap", f"WITH {JOINT}, {OWN}, m AS (SELECT rep, agency, cell_id, sum(we * share) AS je, sum(wl * share) AS jl FROM j JOIN wy USING (season) GROUP BY ALL), p AS (SELECT *, sum(je) OVER (PARTITION BY rep, agency) AS pe, sum(jl) OVER (PARTITION BY rep, agency) AS pl FROM m), {SPLIT} {spans('r', ['between_share', 'within_share', 'total_variation'])}")
def between_bootstrap(spark, d):
    p = density.with_cell(points(spark, d)).groupBy("season", "agency", "cell_id").agg(F.count("*").alias("n"))
    joint = p.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("season"))).drop("n")
    return tidy(resampled.between_bootstrap(joint, resampled.year_weights(periods(spark, d), 3, DRAWS, 5, circular=False), "agency"))


@query("exposure_bootstrap", f"""WITH {STATE}, {CIRCULAR}, m AS (SELECT rep, cell_id, sum(we * w) AS w1, sum(wl * w) AS w2, sum(we * h) AS h1, sum(wl * h) AS h2, sum(we * w * h) AS x1, sum(wl * w * h) AS x2 FROM st JOIN wy USING (season) GROUP BY ALL),
r AS (SELECT rep, sum(x2 - x1) AS delta, sum((w2 - w1) * (h1 + h2) / 2) AS redistribution, sum((w1 + w2) / 2 * (h2 - h1)) AS state_change, sum(x2 - w2 * h2 - x1 + w1 * h1) AS covariation FROM m GROUP BY rep)
{spans("r", ["delta", "redistribution", "state_change", "covariation"])}""")
def exposure_bootstrap(spark, d):
    p = density.with_cell(points(spark, d)).groupBy("season", F.col("agency").alias("cell_id")).agg(F.count("*").alias("n"), F.avg("wind").alias("h"))
    state = p.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("season")))
    return tidy(resampled.exposure_bootstrap(state, resampled.year_weights(periods(spark, d), 3, DRAWS, 5)))


@query("label_permutation", f"""WITH {PTS}, {CELLS}, f AS (SELECT season, sid, cell_id, count(*) / sum(count(*)) OVER (PARTITION BY season, sid)::DOUBLE AS share FROM cells GROUP BY season, sid, cell_id),
l AS (SELECT season, sid, CASE WHEN season <= 15 THEN 'e' ELSE 'l' END AS period, arg_min(agency, (iso_time, event_id)) AS label, row_number() OVER (PARTITION BY season ORDER BY sid) AS r FROM cells GROUP BY season, sid),
mv AS (SELECT rep, season, sid, period, row_number() OVER (PARTITION BY rep, season ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5('3_' || rep || '_' || season || '_' || sid) END, sid) AS r FROM l, (SELECT unnest(range({SHUFFLES + 1})) AS rep)),
yn AS (SELECT season, period, count(*) AS n FROM l GROUP BY ALL), yw AS (SELECT season, 1.0::DOUBLE / (n * count(*) OVER (PARTITION BY period)) AS w FROM yn),
m AS (SELECT rep, l.label, cell_id, coalesce(sum(share * w) FILTER (mv.period = 'e'), 0) AS je, coalesce(sum(share * w) FILTER (mv.period = 'l'), 0) AS jl FROM mv JOIN l ON l.season = mv.season AND l.r = mv.r JOIN f ON f.season = mv.season AND f.sid = mv.sid JOIN yw ON yw.season = mv.season GROUP BY ALL),
pi AS (SELECT label, coalesce(sum(w) FILTER (period = 'e'), 0) AS pe, coalesce(sum(w) FILTER (period = 'l'), 0) AS pl FROM l JOIN yw USING (season) GROUP BY label),
p AS (SELECT * FROM m JOIN pi USING (label)), {SPLIT}, o AS (SELECT between_share AS observed FROM r WHERE rep = 0),
z AS (SELECT max(observed) AS observed, avg(between_share) AS mean, stddev_samp(between_share) AS sd, quantile_cont(between_share, 0.025) AS low, quantile_cont(between_share, 0.5) AS median, quantile_cont(between_share, 0.975) AS high,
  (sum((round(between_share, 9) <= round(observed, 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE AS p_lower, (sum((round(between_share, 9) >= round(observed, 9))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE AS p_upper, count(between_share) AS n FROM r, o WHERE rep > 0)
SELECT round(observed, 7) AS observed, round(mean, 7) AS mean, round(sd, 7) AS sd, round(low, 7) AS low, round(median, 7) AS median, round(high, 7) AS high, round(p_lower, 6) AS p_lower, round(p_upper, 6) AS p_upper, n, round(least(1.0::DOUBLE, 2 * least(p_lower, p_upper)), 6) AS p_two_sided FROM z""")
def label_permutation(spark, d):
    p = density.with_cell(points(spark, d))
    fields = p.groupBy("season", "sid", "cell_id").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("season", "sid"))).drop("n")
    labels = p.groupBy("season", "sid").agg(F.min_by("agency", F.struct("iso_time", "event_id")).alias("label")).withColumn("period", F.when(F.col("season") <= 15, "e").otherwise("l"))
    out = resampled.label_permutation(fields, labels, SHUFFLES, 3)
    return r6(out, "p_lower", "p_upper", "p_two_sided").withColumns({c: F.round(c, 7) for c in ("observed", "mean", "sd", "low", "median", "high")})


@query("period_effect", f"""WITH {PTS}, {SHARES}, {BLOCKS}, {PLACES}, y0 AS (SELECT season, row_number() OVER (ORDER BY season) - 1 AS i, avg(wind) AS a, count(*)::DOUBLE AS b, (season > 15)::INT::DOUBLE AS q, 1 / sqrt(count(*) OVER ()) AS u FROM pts GROUP BY season),
y1 AS (SELECT *, a - u * sum(a * u) OVER () AS a1, b - u * sum(b * u) OVER () AS b1, q - u * sum(q * u) OVER () AS q1 FROM y0), y2 AS (SELECT *, a1 / sqrt(sum(a1 * a1) OVER ()) AS v FROM y1),
y3 AS (SELECT *, b1 - v * sum(b1 * v) OVER () AS b2, q1 - v * sum(q1 * v) OVER () AS q2 FROM y2), y4 AS (SELECT *, b2 / sqrt(sum(b2 * b2) OVER ()) AS x FROM y3), y5 AS (SELECT *, q2 - x * sum(q2 * x) OVER () AS q3 FROM y4),
yr AS (SELECT season, i, u, v, x, q3 / sqrt(sum(q3 * q3) OVER ()) AS q FROM y5),
pj AS (SELECT s.i AS i1, t.i AS i2, s.q AS q1, t.q AS q2, (s.i = t.i)::INT - s.u * t.u - s.v * t.v - s.x * t.x AS m FROM yr s, yr t),
raw AS (SELECT s.i AS a, t.i AS b, sum(sqrt(k.share) * sqrt(l.share)) AS g FROM shares k JOIN shares l USING (cell_id) JOIN yr s ON s.season = k.season JOIN yr t ON t.season = l.season GROUP BY ALL),
hf AS (SELECT i1, b, sum(m * g) AS g FROM pj JOIN raw ON raw.a = pj.i2 GROUP BY ALL), gr AS (SELECT hf.i1 AS a, pj.i2 AS b, sum(g * m) AS g FROM hf JOIN pj ON pj.i1 = hf.b GROUP BY ALL),
mv AS (SELECT rep, position, i AS j FROM plc JOIN yr USING (season)), r AS (SELECT s.rep, sum(q1 * q2 * g) AS ss, sum(m * g) AS total, sqrt(count(*)) - 4 AS df FROM mv s JOIN mv t ON s.rep = t.rep JOIN gr ON gr.a = s.j AND gr.b = t.j JOIN pj ON pj.i1 = s.position AND pj.i2 = t.position GROUP BY s.rep),
f AS (SELECT rep, ss / ((total - ss) / df) AS f, ss / total AS r2 FROM r), o AS (SELECT f AS seen, r2 FROM f WHERE rep = 0)
SELECT round(max(seen), 6) AS f, round(max(o.r2), 6) AS partial_r2, round((sum((round(f, 7) >= round(seen, 7))::INT) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM f, o WHERE rep > 0""")
def period_effect(spark, d):
    responses = density.composition(points(spark, d)).select("season", "cell_id", F.sqrt("share").alias("v"))
    years = points(spark, d).groupBy("season").agg(F.avg("wind").alias("a"), F.count("*").alias("b")).withColumn("late", (F.col("season") > 15).cast("int"))
    return r6(resampled.freedman_lane(responses, years, ["a", "b"], "late", blocks_of(spark, d), SHUFFLES, 11), "f", "partial_r2", "p_value")
