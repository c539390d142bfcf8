"""Named queries of trends and of period effects beside covariates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import Z95, sql_simpson
from ..operators import density, packed, spectra, trends
from ..sources.adapters import points
from .registry import BLOCKS, PLACES, PTS, SHARES, SHUFFLES, blocks_of, query, r6
from .statistics import yearly

#: Three yearly series of each agency: (agency, metric, season, v).
SERIES = f"{PTS}, yl AS (SELECT agency, season, avg(lat) AS v, avg(wind) AS w, count(*)::DOUBLE AS n FROM pts GROUP BY ALL), ser AS (SELECT agency, 'lat' AS metric, season, v FROM yl UNION ALL SELECT agency, 'wind', season, w FROM yl UNION ALL SELECT agency, 'count', season, n FROM yl)"
NORMAL_P = f"CASE WHEN z IS NOT NULL THEN greatest(0.0::DOUBLE, 1 - sqrt(2 / pi()) * {sql_simpson('exp(-@ * @ / 2)', 'least(abs(z), 9.0::DOUBLE)')}) END"
TREND = f"""num AS (SELECT *, row_number() OVER (PARTITION BY agency, metric ORDER BY season, v)::DOUBLE AS i, count(*) OVER (PARTITION BY agency, metric)::DOUBLE AS n,
  count(*) OVER (PARTITION BY agency, metric, v) AS kv FROM ser),
bas AS (SELECT agency, metric, any_value(n) AS n, min(season) AS first, max(season) AS last, avg(v) AS mean, sum((kv - 1) * (2 * kv + 5))::DOUBLE AS tie FROM num GROUP BY ALL),
prs AS (SELECT a.agency, a.metric, list_sort(list((b.v - a.v) / (b.season - a.season))) AS slopes, median((b.v - a.v) / (b.i - a.i)) AS step, sum(sign(b.v - a.v))::DOUBLE AS mk_s
  FROM num a JOIN num b ON a.agency = b.agency AND a.metric = b.metric AND a.i < b.i GROUP BY ALL),
flt AS (SELECT num.*, round(v - i * step, 9) AS d FROM num JOIN prs USING (agency, metric)),
rnk AS (SELECT *, rank() OVER (PARTITION BY agency, metric ORDER BY d) + (count(*) OVER (PARTITION BY agency, metric, d) - 1) / 2.0::DOUBLE - (n + 1) / 2 AS dev FROM flt),
spr AS (SELECT agency, metric, sum(dev * dev) AS spread FROM rnk GROUP BY ALL),
lag AS (SELECT a.agency, a.metric, b.i - a.i AS k, sum(a.dev * b.dev) AS c, any_value(a.n) AS n FROM rnk a JOIN rnk b ON a.agency = b.agency AND a.metric = b.metric AND a.i < b.i GROUP BY ALL),
xtr AS (SELECT agency, metric, sum(CASE WHEN abs(c / spread) > {Z95} / sqrt(n) THEN (n - k) * (n - k - 1) * (n - k - 2) * (c / spread) ELSE 0 END) AS extra FROM lag JOIN spr USING (agency, metric) GROUP BY ALL),
var AS (SELECT *, n * (n - 1) * (2 * n + 5) - tie AS whole, len(slopes) AS m FROM bas JOIN prs USING (agency, metric) JOIN xtr USING (agency, metric)),
zed AS (SELECT *, sqrt(whole / 18) AS sigma, CASE WHEN 1 + 2 / (n * (n - 1) * (n - 2)) * extra > 0 THEN (mk_s - sign(mk_s)) / sqrt(whole / 18 * (1 + 2 / (n * (n - 1) * (n - 2)) * extra)) END AS z FROM var),
trd AS (SELECT agency, metric, first, last, n::BIGINT AS n, mean, list_median(slopes) AS slope, slopes[(greatest(round_even((m - {Z95} * sigma) / 2, 0) - 1, 0) + 1)::INT] AS low,
  slopes[(least(round_even((m + {Z95} * sigma) / 2, 0), m - 1) + 1)::INT] AS high, mk_s, z, {NORMAL_P} AS p FROM zed)"""
LABEL = "CASE WHEN p < 0.05 AND z > 0 THEN 'increasing' WHEN p < 0.05 THEN 'decreasing' ELSE 'no trend' END AS trend"


def three_series(spark, d):
    rows = yearly(spark, d)
    return rows.select("agency", "season", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in (("lat", "v"), ("wind", "w"), ("count", "n"))])))


@query("trend_summary", f"WITH {SERIES}, {TREND} SELECT agency, metric, n, round(mean, 6) AS mean, round(slope, 6) AS slope, round(low, 6) AS low, round(high, 6) AS high, mk_s, round(z, 6) AS z, round(p, 6) AS p, {LABEL} FROM trd")
def trend_summary(spark, d):
    return r6(trends.trend_summary(three_series(spark, d), ["agency", "metric"], "season", "v"), "mean", "slope", "low", "high", "z", "p")


DRAWS = 999


@query("trend_rows", f"""WITH {SERIES}, {TREND}, res AS (SELECT agency, metric, num.season, num.v - slope * num.season AS raw, slope, i - 1 AS i, num.n FROM num JOIN trd USING (agency, metric)),
med AS (SELECT agency, metric, median(raw) AS base FROM res GROUP BY ALL), fit AS (SELECT res.*, base + slope * season AS line, raw - base AS resid FROM res JOIN med USING (agency, metric)),
drw AS (SELECT fit.*, rep, (('0x' || substr(md5('5_' || agency || '_' || metric || '_' || rep || '_' || (i::BIGINT // 3)), 1, 8))::BIGINT % (n::BIGINT - 2) + i::BIGINT % 3) AS j FROM fit, (SELECT unnest(range(1, {DRAWS + 1})) AS rep)),
smp AS (SELECT drw.agency, drw.metric, rep, drw.season, drw.line + fit.resid AS v FROM drw JOIN fit ON fit.agency = drw.agency AND fit.metric = drw.metric AND fit.i = drw.j),
slp AS (SELECT a.agency, a.metric, a.rep, median((b.v - a.v) / (b.season - a.season)) AS slope FROM smp a JOIN smp b ON a.agency = b.agency AND a.metric = b.metric AND a.rep = b.rep AND a.season < b.season GROUP BY ALL),
spn AS (SELECT agency, metric, quantile_cont(slope, 0.025) AS lo, quantile_cont(slope, 0.975) AS hi FROM slp GROUP BY ALL),
adj AS (SELECT *, p * count(p) OVER f / (count(p) OVER (f ORDER BY p)) AS x FROM trd WINDOW f AS (PARTITION BY metric))
SELECT agency, metric, first::INT AS start, last::INT AS end, n, round(mean, 6) AS mean, round(slope, 6) AS slope_year, round(slope * 10, 6) AS slope_decade, round(lo * 10, 6) AS low_decade, round(hi * 10, 6) AS high_decade,
  round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, min(x) OVER (PARTITION BY metric ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q, {LABEL} FROM adj JOIN spn USING (agency, metric)""")
def trend_rows(spark, d):
    out = trends.trend_rows(three_series(spark, d), ["agency", "metric"], ["metric"], "season", "v", 3, DRAWS, 5)
    return r6(out, "mean", "slope_year", "slope_decade", "low_decade", "high_decade", "p", "q")


CUTS = list(range(10, 21))


@query("series_permutation", f"""WITH {SERIES}, {BLOCKS}, {PLACES}, d AS (SELECT agency, metric, c AS n_early, rep, avg(v) FILTER (position >= c) - avg(v) FILTER (position < c) AS d FROM plc JOIN ser USING (season), (SELECT unnest({CUTS}) AS c) GROUP BY ALL),
o AS (SELECT agency, metric, n_early, d AS seen FROM d WHERE rep = 0) SELECT agency, metric, n_early, round(any_value(seen), 6) AS difference, round((count(*) FILTER (round(abs(d), 9) >= round(abs(seen), 9)) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM d JOIN o USING (agency, metric, n_early) WHERE rep > 0 GROUP BY ALL""")
def series_permutation(spark, d):
    """All series at all cuts from the tenth to the twentieth year, under the same shuffles."""
    out = packed.series_permutation(three_series(spark, d), ["agency", "metric"], "v", blocks_of(spark, d), CUTS, SHUFFLES, 11)
    return r6(out, "difference", "p_value")


@query("cutpoint_fields", f"""WITH {PTS}, {SHARES}, {BLOCKS}, {PLACES}, n AS (SELECT count(*) AS n FROM blk), c AS (SELECT c AS n_early, rep, cell_id, sum(CASE WHEN position >= c THEN share ELSE 0 END) / any_value(n - c) - sum(CASE WHEN position < c THEN share ELSE 0 END) / c AS d FROM plc JOIN shares USING (season), n, (SELECT unnest({CUTS}) AS c) GROUP BY c, rep, cell_id),
t AS (SELECT n_early, rep, 0.5 * sum(abs(d)) AS tv FROM c GROUP BY ALL), o AS (SELECT n_early, tv AS seen FROM t WHERE rep = 0) SELECT n_early, round(any_value(seen), 6) AS tv, round((count(*) FILTER (round(tv, 9) >= round(seen, 9)) + 1) / {SHUFFLES + 1}.0::DOUBLE, 6) AS p_value FROM t JOIN o USING (n_early) WHERE rep > 0 GROUP BY ALL""")
def cutpoint_fields(spark, d):
    return r6(packed.cutpoint_fields(density.composition(points(spark, d)), blocks_of(spark, d), CUTS, SHUFFLES, 11), "tv", "p_value")


WAVE = f"""num AS (SELECT agency, v, row_number() OVER (PARTITION BY agency ORDER BY season) - 1 AS t, count(*) OVER (PARTITION BY agency)::DOUBLE AS n FROM yl), fit AS (SELECT agency, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM num GROUP BY agency),
res AS (SELECT agency, t, n, v - a - b * t AS r FROM num JOIN fit USING (agency)), std AS (SELECT *, r / stddev_samp(r) OVER (PARTITION BY agency) AS z FROM res), lg AS (SELECT *, lag(z) OVER (PARTITION BY agency ORDER BY t) AS z0 FROM std), ar AS (SELECT agency, corr(z, z0) AS ar FROM lg WHERE z0 IS NOT NULL GROUP BY agency),
frq AS (SELECT agency, n, k, 2 * pi() * k / n AS w, sum(z * cos(2 * pi() * k / n * t)) AS re, sum(-z * sin(2 * pi() * k / n * t)) AS im FROM (SELECT *, unnest(range(1, (n / 2)::INT + 1)) AS k FROM std) GROUP BY agency, n, k),
scl AS (SELECT *, 2 * pow(2, j * 0.125::DOUBLE) AS s FROM (SELECT *, unnest(range(round_even(log2(n / 2) / 0.125, 0)::INT + 1)) AS j FROM frq)),
dau AS (SELECT *, sqrt(2 * pi() * s) * pow(pi(), -0.25::DOUBLE) * exp(-pow(s * w - 6, 2) / 2) / n AS d FROM scl),
wav AS (SELECT agency, n, j, s, t, sum(d * (re * cos(w * t) - im * sin(w * t))) AS a, sum(d * (re * sin(w * t) + im * cos(w * t))) AS b FROM (SELECT *, unnest(range(n::INT)) AS t FROM dau) GROUP BY agency, n, j, s, t),
pow AS (SELECT agency, n, j, t, s * 4 * pi() / (6 + sqrt(38)) AS period, a * a + b * b AS power, ar FROM wav JOIN ar USING (agency))"""


@query("wavelet_power", f"WITH {PTS}, yl AS (SELECT agency, season, avg(lat) AS v FROM pts GROUP BY ALL), {WAVE} SELECT agency, j, t::INT AS t, round(period, 6) AS period, round(power, 6) AS power, round(power / ((1 - ar * ar) / (1 - 2 * ar * cos(2 * pi() / period) + ar * ar) * -ln(0.05)), 6) AS ratio, period <= greatest(least(t, n - 1 - t), 1e-5) * 4 * pi() / (6 + sqrt(38)) / sqrt(2) + 1e-9 AS inside FROM pow")
def wavelet_power(spark, d):
    return r6(spectra.wavelet_power(yearly(spark, d).select("agency", "season", "v"), ["agency"], "season", "v"), "period", "power", "ratio").withColumn("t", F.col("t").cast("int"))


@query("log_sum", f"""WITH {PTS}, c AS (SELECT floor(lat / 10)::INT AS cell, season, season % 3 AS month, count(*)::DOUBLE AS a, avg(wind) AS b, avg(lon) - 139 AS c FROM pts GROUP BY ALL), l AS (SELECT *, ln(a) AS la, ln(b) AS lb, ln(c) AS lc FROM c WHERE a > 0 AND b > 0 AND c > 0)
SELECT cell, season, round(la - avg(la) OVER w, 7) + 0 AS log_a, round(lb - avg(lb) OVER w, 7) + 0 AS log_b, round(lc - avg(lc) OVER w, 7) + 0 AS log_c, round(la + lb + lc - avg(la + lb + lc) OVER w, 7) + 0 AS total, abs(la + lb + lc - avg(la + lb + lc) OVER w - (la - avg(la) OVER w + lb - avg(lb) OVER w + lc - avg(lc) OVER w)) < 1e-10 AS closed FROM l WINDOW w AS (PARTITION BY cell, month)""")
def log_sum(spark, d):
    rows = points(spark, d).groupBy(F.floor(F.col("lat") / 10).cast("int").alias("cell"), "season").agg(F.count("*").cast("double").alias("a"), F.avg("wind").alias("b"), (F.avg("lon") - 139).alias("c"))
    out = spectra.log_sum(rows.withColumn("month", F.col("season") % 3), ["cell"], "month", ["a", "b", "c"])
    return out.select("cell", "season", *[(F.round(c, 7) + 0.0).alias(c) for c in ("log_a", "log_b", "log_c", "total")], (F.abs("residual") < 1e-10).alias("closed"))
