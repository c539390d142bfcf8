"""Named queries of fitted models, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import Z95, sql_simpson
from ..operators import fits, inference, tracks
from ..sources.adapters import points
from ..sources.adapters import tracks as smooth
from .registry import PTS, query, r6
from .statistics import yearly


@query("ridge_time_folds")
def ridge_time_folds(spark, d):
    rows = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("a"), F.avg("lon").alias("b"), F.count("*").alias("c"), F.avg("wind").alias("v"))
    return r6(fits.ridge_time_folds(rows, ["agency"], "season", "v", ["a", "b", "c"]), "coef", "alpha")


@query("regression_table", f"""WITH {PTS}, m AS (SELECT agency, season, avg(lat) AS x, avg(wind) AS y FROM pts GROUP BY ALL), n AS (SELECT agency, row_number() OVER w AS k, (x - avg(x) OVER p) / stddev_samp(x) OVER p AS x, (y - avg(y) OVER p) / stddev_samp(y) OVER p AS y FROM m WINDOW w AS (PARTITION BY agency ORDER BY season), p AS (PARTITION BY agency)),
b AS (SELECT agency, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_sxx(y, x) * count(*) AS det, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, corr(y, x) ** 2 AS r2, sum(y * y) AS sst FROM n GROUP BY agency),
g AS (SELECT agency, k, x, y - b0 - b1 * x AS e FROM n JOIN b USING (agency)), s AS (SELECT u.agency, sum(w * u.e * v.e) AS s00, sum(w * u.e * v.e * v.x) AS s01, sum(w * u.e * v.e * u.x * v.x) AS s11 FROM g u JOIN g v ON u.agency = v.agency AND abs(u.k - v.k) <= 3, LATERAL (SELECT 1 - abs(u.k - v.k) / 4.0::DOUBLE AS w) GROUP BY u.agency),
f AS (SELECT *, (1 - r2) * sst AS sse FROM b JOIN s USING (agency)), t AS (SELECT agency, 'x' AS term, b1 AS coef, sqrt(greatest(sx * sx * s00 - 2 * sx * n * s01 + n * n * s11, 0)) / det AS se, n, r2, sse FROM f), z AS (SELECT *, coef / se AS z, -n / 2.0::DOUBLE * (ln(2 * pi()) + ln(sse / n) + 1) AS ll FROM t)
SELECT agency, term, round(coef, 6) AS coef, round(se, 6) AS se, round(greatest(0.0::DOUBLE, 1 - sqrt(2 / pi()) * {sql_simpson('exp(-@ * @ / 2)', 'least(abs(z), 9.0::DOUBLE)')}), 6) AS p, round(coef - {Z95} * se, 6) AS low, round(coef + {Z95} * se, 6) AS high, n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted_r2, round(4 - 2 * ll, 4) AS aic, round(2 * ln(n) - 2 * ll, 4) AS bic FROM z""")
def regression_table(spark, d):
    rows = points(spark, d).groupBy("agency", "season").agg(F.avg("lat").alias("x"), F.avg("wind").alias("y"))
    out = fits.regression_table(rows, ["agency"], "season", "y", ["x"]).where("term = 'x'")
    return r6(out, "coef", "se", "p", "low", "high", "r2", "adjusted_r2").withColumns({c: F.round(c, 4) for c in ("aic", "bic")})


@query("glm_binomial")
def glm_binomial(spark, d):
    """Strong points by place, errors clustered by season."""
    p = points(spark, d).select("season", (F.col("wind") >= 60).cast("double").alias("strong"), ((F.col("lat") - 20) / 10).alias("north"), ((F.col("lon") - 140) / 20).alias("east"))
    return r6(fits.glm_table(p, "strong", ["north", "east"], "binomial", cluster="season"), "coef", "se", "p", "low", "high", "chi2_df")


@query("glm_poisson")
def glm_poisson(spark, d):
    """Points of an agency and season by their mean wind, with the season's entities as exposure, errors by season up to three apart."""
    p = points(spark, d).groupBy("season", "agency").agg(F.count("*").cast("double").alias("n"), ((F.avg("wind") - 50) / 10).alias("wind"), F.log(F.countDistinct("sid").cast("double")).alias("exposure"))
    return r6(fits.glm_table(p, "n", ["wind"], "poisson", "exposure", cluster="season", lags=3), "coef", "se", "p", "low", "high", "dispersion", "chi2_df")


def shapes(spark, d):
    """Each entity's path as 20 longitudes, scaled to the middle latitude, and 20 latitudes."""
    steps = tracks.resample(smooth(spark, d)).withColumn("x", F.col("lon") * F.cos(F.radians(F.lit(20.0))))
    lists = F.array_sort(F.collect_list(F.struct("k", "x", "lat")))
    rows = steps.groupBy("sid").agg(lists.alias("p")).select("sid", F.concat(F.transform("p", lambda z: z["x"]), F.transform("p", lambda z: z["lat"])).alias("values"))
    return fits.standard_vectors(rows, "sid", "values")


@query("cluster_scan")
def cluster_scan(spark, d):
    out, _ = fits.cluster_scan(shapes(spark, d), "sid", "vector", [3, 4, 5, 6, 7], 20)
    return out.select("k", "seed", F.round("xb", 4).alias("xb"), F.round("fpc", 4).alias("fpc"), F.round("ari", 4).alias("ari"), "best_of_k", "selected")


@query("cluster_families")
def cluster_families(spark, d):
    """Every entity's family and membership under the chosen centers, numbered from west to east, and the family's size and mean start."""
    rows = shapes(spark, d)
    _, centers = fits.cluster_scan(rows, "sid", "vector", [3, 4, 5, 6, 7], 20)
    own = inference.fuzzy_membership(rows, "vector", centers.tolist()).select("sid", F.get("raw", F.lit(0)).alias("start"), F.posexplode("membership").alias("old", "membership"))
    place = own.groupBy("old").agg((F.sum(F.col("membership") * F.col("start")) / F.sum("membership")).alias("west"))
    ladder = place.agg(F.array_sort(F.collect_list(F.struct("west", "old"))).alias("order")).select(F.posexplode("order").alias("family", "o")).select("family", F.col("o.old").alias("old"))
    best = own.groupBy("sid").agg(F.max_by("old", F.struct("membership", -F.col("old"))).alias("old"), F.max("membership").alias("membership"), F.first("start").alias("start"))
    named = best.join(F.broadcast(ladder), "old")  # a row a family
    size = named.groupBy("family").agg(F.count("*").alias("size"), F.avg("start").alias("mean_start"))
    return named.join(F.broadcast(size), "family").select("sid", "family", F.round("membership", 4).alias("membership"), "size", F.round("mean_start", 4).alias("mean_start"))
