"""Fitted models: ridge with expanding time folds, regression tables, generalized linear models with robust errors, and the choice among fuzzy clusterings.

Tables are reduced to sums of products in Spark, once a step; what is solved is as small as the number of terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..functions.tails import Z95, normal_two_sided
from .models import hac_regression

ALPHAS = np.logspace(-3, 3, 50)
FEW = 16  # tasks whose sums the driver adds itself; those of more are added by a shuffle
LANE = 256  # vectors that meet all centers at once; their memberships stay in the processor's cache


def known_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns).where(" AND ".join(f"NOT isnan({c})" for c in columns))


def moments(columns: list[str]) -> list:
    """Sums of products of a constant and the columns, as columns m0_0, m0_1, ..."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    return [F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]


def unfolded(row, k: int) -> np.ndarray:
    return np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)


def choose_ridge(parts: list[np.ndarray], alphas: np.ndarray = ALPHAS) -> tuple[float, np.ndarray]:
    """Penalty and standardised coefficients, from the sums of products (constant, x, y) of consecutive parts of a series.

    Fold i is fitted on the parts before i and judged on part i by R squared; the penalty with the best mean is
    taken, the smallest of equals.
    """
    whole = sum(parts)
    n, mean = whole[0, 0], whole[0] / whole[0, 0]
    sd = np.sqrt(np.maximum((np.diag(whole) - n * mean * mean) / (n - 1), 0))
    scale = np.diag(np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0))
    scale[:, 0] = -np.diag(scale) * mean
    scale[0] = np.eye(len(mean))[0]
    parts = [scale @ p @ scale.T for p in parts]

    def solve(a: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        m = a[0] / a[0, 0]
        c = a - a[0, 0] * np.outer(m, m)
        beta = np.linalg.solve(c[1:-1, 1:-1] + alpha * np.eye(len(a) - 2), c[1:-1, -1])
        return m[-1] - m[1:-1] @ beta, beta

    scores = np.zeros(len(alphas))
    for i in range(1, len(parts)):
        train, test = sum(parts[:i]), parts[i]
        for j, alpha in enumerate(alphas):
            const, beta = solve(train, alpha)
            g = np.concatenate([[-const], -beta, [1.0]])
            scores[j] += 1 - (g @ test @ g) / (test[-1, -1] - test[0, -1] ** 2 / test[0, 0])
    best = int(np.argmax(np.round(scores / (len(parts) - 1), 12)))
    return float(alphas[best]), solve(sum(parts), alphas[best])[1]


def ridge_time_folds(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], alphas: np.ndarray = ALPHAS) -> DataFrame:
    """(keys, term, coef, alpha, folds, n) of each series: standardised ridge coefficients, the penalty chosen on folds in time.

    Of n rows there are min(5, max(2, n // 8)) folds, each of n // (folds + 1) rows behind all that it is fitted on.
    Every row adds to the products of one part; fits use running sums of parts, so nothing is read again.
    A series of fewer than 6 rows has no coefficients and is left out.
    """
    columns, k = [*xs, y], len(xs) + 2
    rows = known_rows(df, columns).withColumns({"__i": F.row_number().over(Window.partitionBy(*keys).orderBy(order, *columns)) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    folds = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("__n") / 8))).cast("int")
    rows = rows.where("__n >= 6").withColumn("__folds", folds).withColumn("__size", F.floor(F.col("__n") / (F.col("__folds") + 1)))
    part = F.greatest(F.lit(0), F.col("__folds") - F.floor((F.col("__n") - 1 - F.col("__i")) / F.col("__size")))
    sums = rows.groupBy(*keys, part.alias("__part")).agg(F.first("__folds").alias("__folds"), F.first("__n").alias("__n"), *moments(columns))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", term string, coef double, alpha double, folds int, n long"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        alpha, beta = choose_ridge([unfolded(r, k) for r in pdf.to_dict("records")], alphas)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "term": xs, "coef": beta, "alpha": alpha, "folds": int(pdf["__folds"].iloc[0]), "n": int(pdf["__n"].iloc[0])})

    return sums.groupBy(*keys).applyInPandas(solve, schema)


def regression_table(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], lags: int = 3) -> DataFrame:
    """Regression on z-scores of each short series: (keys, term, coef, se, p, low, high, n, r2, adjusted_r2, aic, bic), with errors that allow for autocorrelation up to ``lags``."""
    columns = [y, *xs]
    own = Window.partitionBy(*keys)
    rows = known_rows(df, columns)
    z = rows.select(*keys, order, *[((F.col(c) - F.avg(c).over(own)) / F.stddev_samp(c).over(own)).alias(c) for c in columns])
    terms = hac_regression(z, keys, order, y, xs, lags)
    wide = terms.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("__b"))
    fit = z.join(wide, keys)
    line = sum((F.element_at("__b", F.lit(x)) * F.col(x) for x in xs), F.element_at("__b", F.lit("const")))
    whole = fit.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col(y) - line) ** 2).alias("sse"), F.sum(F.col(y) * F.col(y)).alias("sst"))
    n, k = F.col("n"), len(xs) + 1
    loglik = -n / 2 * (math.log(2 * math.pi) + F.log(F.col("sse") / n) + 1)
    whole = whole.withColumn("r2", 1 - F.col("sse") / F.col("sst")).select(
        *keys, "n", "r2", (1 - (1 - F.col("r2")) * (n - 1) / (n - k)).alias("adjusted_r2"), (2 * k - 2 * loglik).alias("aic"), (F.log(n) * k - 2 * loglik).alias("bic"),
    )
    out = terms.withColumns({"p": normal_two_sided(F.try_divide("coef", "se")), "low": F.col("coef") - Z95 * F.col("se"), "high": F.col("coef") + Z95 * F.col("se")})
    return out.join(whole, keys)


def glm_means(beta: np.ndarray, xs: list[str], family: str, offset: str | None) -> tuple:
    """Expressions of the mean, its derivative by the linear predictor, and the variance for a dispersion."""
    eta = (F.col(offset) if offset else F.lit(0.0)) + sum((F.col(x) * float(b) for x, b in zip(xs, beta[1:])), F.lit(float(beta[0])))
    if family == "binomial":
        mu = 1 / (1 + F.exp(-eta))
        return mu, mu * (1 - mu), lambda a: mu * (1 - mu)
    mu = F.exp(eta)
    return mu, mu, lambda a: mu + a * mu * mu


def fit_glm(df: DataFrame, y: str, xs: list[str], family: str, offset: str | None, dispersion: float = 0.0, steps: int = 50, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and the inverse of the information, by iterated weighted least squares; a step is one aggregation."""
    k, beta = len(xs) + 1, np.zeros(len(xs) + 1)
    z = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    for _ in range(steps):
        mu, slope, variance = glm_means(beta, xs, family, offset)
        weight = F.greatest(slope * slope / variance(dispersion), F.lit(1e-10))
        score = (F.col(y) - mu) * slope / variance(dispersion)
        row = df.agg(*[F.sum(weight * z[i] * z[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(score * c).alias(f"s{i}") for i, c in enumerate(z)]).first()
        inverse = np.linalg.pinv(unfolded(row, k))
        step = inverse @ np.array([row[f"s{i}"] or 0.0 for i in range(k)])
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return beta, inverse


def glm_table(df: DataFrame, y: str, xs: list[str], family: str = "binomial", offset: str | None = None, cluster: str | None = None, lags: int | None = None, overdispersed: float = 1.5) -> DataFrame:
    """(term, coef, se, p, low, high, family, dispersion, chi2_df, n, clusters) of a binomial or Poisson model.

    Errors are a sandwich: scores are summed by ``cluster`` in Spark; with ``lags`` clusters count as consecutive
    moments, and products of scores up to so many apart are added with falling weights, else each cluster counts
    by itself, with the correction for few clusters.  Without a cluster they are the model's own.  A Poisson model
    whose Pearson statistic exceeds ``overdispersed`` a degree of freedom becomes negative binomial with variance
    mu + a mu^2: a is where the statistic equals its degrees of freedom, found by halving on sums for several a at once.
    """
    if family not in ("binomial", "poisson"):
        raise ValueError(f"unknown family: {family}")
    spark, k = df.sparkSession, len(xs) + 1
    df = cut(known_rows(df.select(*dict.fromkeys([y, *xs, *([offset] if offset else []), *([cluster] if cluster else [])])), [y, *xs, *([offset] if offset else [])]))
    n, dispersion, name = df.count(), 0.0, family
    if n <= k:
        raise ValueError("fewer rows than terms")
    beta, inverse = fit_glm(df, y, xs, family, offset)

    def pearson(values: list[float]) -> list[float]:
        mu, _, variance = glm_means(beta, xs, family, offset)
        return [v / (n - k) for v in df.agg(*[F.sum((F.col(y) - mu) ** 2 / variance(a)).alias(f"p{i}") for i, a in enumerate(values)]).first()]

    ratio = pearson([0.0])[0]
    if family == "poisson" and ratio > overdispersed:
        name = "negative_binomial"
        for _ in range(30):
            low, high = 0.0, 1.0
            while pearson([high])[0] > 1:
                low, high = high, high * 16
            while high - low > 1e-10 * max(1.0, high):
                grid = np.linspace(low, high, 17)
                above = [p > 1 for p in pearson(grid.tolist())]
                at = max((i for i, more in enumerate(above) if more), default=0)
                low, high = float(grid[at]), float(grid[min(at + 1, 16)])
            before, dispersion = dispersion, (low + high) / 2
            beta, inverse = fit_glm(df, y, xs, family, offset, dispersion)
            if abs(dispersion - before) < 1e-8:
                break
    groups = None
    covariance = inverse
    if cluster:
        mu, slope, variance = glm_means(beta, xs, family, offset)
        score = (F.col(y) - mu) * slope / variance(dispersion)
        sums = df.groupBy(cluster).agg(*[F.sum(score * c).alias(f"s{i}") for i, c in enumerate([F.lit(1.0), *map(F.col, xs)])])
        pairs = [(i, j) for i in range(k) for j in range(k)]
        if lags is None:
            row = sums.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i, j in pairs]).first()
            groups = row["g"]
            meat = np.array([[row[f"q{i}_{j}"] for j in range(k)] for i in range(k)], float) * groups / max(groups - 1, 1) * (n - 1) / (n - k)
        else:
            w = Window.orderBy(cluster)  # a row a moment
            near = sums
            for lag in range(lags + 1):
                near = near.withColumns({f"l{lag}_{i}": F.lag(f"s{i}", lag).over(w) for i in range(k)})
            row = near.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"l{lag}_{j}")).alias(f"q{lag}_{i}_{j}") for lag in range(lags + 1) for i, j in pairs]).first()
            groups, meat = row["g"], np.zeros((k, k))
            for lag in range(lags + 1):
                c = np.array([[row[f"q{lag}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)], float)
                meat += c if not lag else (1 - lag / (lags + 1)) * (c + c.T)
        covariance = inverse @ meat @ inverse
    se = np.sqrt(np.maximum(np.diag(covariance), 0))
    rows = [(t, float(b), float(s), name, float(dispersion), float(ratio), n, groups) for t, b, s in zip(["const", *xs], beta, se)]
    out = spark.createDataFrame(rows, "term string, coef double, se double, family string, dispersion double, chi2_df double, n long, clusters long")
    return out.withColumns({"p": normal_two_sided(F.try_divide("coef", "se")), "low": F.col("coef") - Z95 * F.col("se"), "high": F.col("coef") + Z95 * F.col("se")})


class Fits:
    """Centers of all fits, one under the other; fit f has rows first[f] to first[f + 1]."""

    def __init__(self, names: list[tuple[int, int]]):
        self.names = names
        self.first = np.concatenate([[0], np.cumsum([k for k, _ in self.names])])

    def memberships(self, x: np.ndarray, centers: np.ndarray, m: float) -> np.ndarray:
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None], 1e-24) ** (-1 / (m - 1))
        return d / np.repeat(np.add.reduceat(d, self.first[:-1], axis=1), np.diff(self.first), axis=1)

    def dealt(self, ids: np.ndarray) -> np.ndarray:
        """Memberships to begin with, from a hash of row, fit and center."""
        out = pd.util.hash_array(np.asarray(ids, np.int64)).astype(np.uint64)[:, None] ^ pd.util.hash_array(np.array([hash_of(*name, j) for name in self.names for j in range(name[0])], np.int64)).astype(np.uint64)[None]
        out ^= out >> np.uint64(33)
        out = out * np.uint64(0xFF51AFD7ED558CCD)
        u = (out >> np.uint64(11)).astype(float) / 2**53 + 1e-9
        return u / np.repeat(np.add.reduceat(u, self.first[:-1], axis=1), np.diff(self.first), axis=1)


def hash_of(k: int, seed: int, center: int) -> int:
    return (k * 100_003 + seed) * 100_003 + center


def cluster_scan(df: DataFrame, id_: str, vector: str, ks: list[int], seeds: int, m: float = 2.0, steps: int = 1000, tolerance: float = 1e-5) -> tuple[DataFrame, np.ndarray]:
    """Fuzzy clusterings for every number of clusters and seed, and the centers of the chosen one.

    Returns (k, seed, xb, fpc, iterations, ari, best_of_k, selected) and centers.  All fits advance together: an iteration is
    one pass in which a task sums every fit's weighted vectors, and the driver gets centers alone.  A fit rests
    when no center moves by ``tolerance``.  xb is compactness over the least distance of centers (smaller is
    better), fpc the mean of squared memberships, ari the agreement of hard labels with the best fit of the same
    k.  Best is the smallest xb, then the largest fpc, then the smallest seed.  Ids are whole numbers, vectors complete.
    Vectors are packed into matrices once and kept by the executors, so that a pass costs little beside its sums.
    """
    spark = df.sparkSession
    data = df.select(F.col(id_).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    data = cut(data.mapInPandas(packed_vectors, "n long, dim long, ids binary, x binary"))
    rows, dim = data.agg(F.sum("n"), F.max("dim")).first()
    if not rows:
        raise ValueError("no vectors")
    blocks = data.rdd.map(lambda r: (np.frombuffer(r.ids, np.int64), np.frombuffer(r.x).reshape(r.n, r.dim))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out, chosen = scanned(blocks, rows, dim, Fits([(k, s) for k in ks for s in range(seeds)]), m, steps, tolerance)
    finally:
        blocks.unpersist()
    schema = "k int, seed int, xb double, fpc double, iterations int, ari double, best_of_k boolean, selected boolean"
    return spark.createDataFrame(out, schema), chosen


def packed_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch as a row: its ids, and its vectors one after the other."""
    for pdf in batches:
        if len(pdf):
            x = np.concatenate(pdf["v"].to_numpy()).astype(float)
            yield pd.DataFrame({"n": [len(pdf)], "dim": [len(x) // len(pdf)], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})


def scanned(blocks: RDD, rows: int, dim: int, fits: Fits, m: float, steps: int, tolerance: float) -> tuple[list[tuple], np.ndarray]:
    """Rows of ``cluster_scan`` and the chosen centers, from blocks of (ids, vectors)."""
    pieces, total, ks = blocks.getNumPartitions(), int(fits.first[-1]), sorted({k for k, _ in fits.names})
    centers, live, iterations = np.zeros((total, dim)), np.ones(len(fits.names), bool), np.zeros(len(fits.names), int)

    def passed(statistics, width: int, total: int = total) -> np.ndarray:
        """Sum over all vectors of ``statistics`` (a matrix of ``total`` centers by ``width``)."""

        def run(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
            out, any_ = np.zeros((total, width)), False
            for ids, x in found:
                for k in range(0, len(x), LANE):
                    out, any_ = out + statistics(ids[k : k + LANE], x[k : k + LANE]), True
            if any_:
                yield out

        parts = blocks.mapPartitions(run)
        return parts.treeReduce(np.add) if pieces > FEW else sum(parts.collect())

    def shares(begin: bool, fits: Fits, now: np.ndarray):
        def statistics(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
            u = (fits.dealt(ids) if begin else fits.memberships(x, now, m)) ** m
            return np.column_stack([u.T @ x, u.sum(0)])

        return statistics

    for step in range(steps):
        of = np.repeat(live, np.diff(fits.first))  # fits at rest take no more part in a pass
        found = passed(shares(step == 0, Fits([name for name, l in zip(fits.names, live) if l]), centers[of]), dim + 1, int(of.sum()))
        new = centers.copy()
        new[of] = found[:, :-1] / found[:, -1:]
        moved = np.maximum.reduceat(np.abs(new - centers).max(1), fits.first[:-1])
        centers = new
        iterations[live] += 1
        if step:
            live &= moved >= tolerance
        if not live.any():
            break

    final = centers

    def spread(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        u = fits.memberships(x, final, m)
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ final.T + (final * final).sum(1)[None], 0)
        return np.column_stack([(u**m * d).sum(0), (u * u).sum(0)])

    sums = np.add.reduceat(passed(spread, 2), fits.first[:-1], axis=0)
    least = []
    for a, b in zip(fits.first, fits.first[1:]):
        c = ((final[a:b, None] - final[None, a:b]) ** 2).sum(2)
        least.append(c[c > 0].min() if (c > 0).any() else np.nan)
    xb, fpc = sums[:, 0] / (rows * np.array(least)), sums[:, 1] / rows
    rank = lambda f: (round(xb[f], 10) if xb[f] == xb[f] else np.inf, -round(fpc[f], 10), fits.names[f][1])
    best = {k: min((f for f, name in enumerate(fits.names) if name[0] == k), key=rank) for k in ks}
    chosen = min(best.values(), key=lambda f: (*rank(f), fits.names[f][0]))
    top = max(ks)

    def crossed(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        u, out = fits.memberships(x, final, m), np.zeros((total, top))
        label = [u[:, a:b].argmax(1) for a, b in zip(fits.first, fits.first[1:])]
        for f, (k, _) in enumerate(fits.names):
            np.add.at(out, (fits.first[f] + label[f], label[best[k]]), 1)
        return out

    table = passed(crossed, top)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    out = []
    for f, (k, seed) in enumerate(fits.names):
        t = table[fits.first[f] : fits.first[f + 1]]
        a, b, chance = pairs(t.sum(1)), pairs(t.sum(0)), pairs(t.sum(1)) * pairs(t.sum(0)) / max(rows * (rows - 1) / 2, 1)
        ari = 1.0 if (a + b) / 2 == chance else (pairs(t) - chance) / ((a + b) / 2 - chance)
        out.append((k, seed, float(xb[f]), float(fpc[f]), int(iterations[f]), float(ari), f == best[k], f == chosen))
    return out, final[fits.first[chosen] : fits.first[chosen + 1]]


def standard_vectors(df: DataFrame, id_: str, values: str) -> DataFrame:
    """(id, vector, raw): arrays of numbers, each place scaled to mean 0 and deviation 1 over all rows; a place without deviation is 0."""
    flat = df.select(id_, F.posexplode(values).alias("at", "x"))
    scale = flat.groupBy("at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = scale.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m", "s"))), lambda z: F.struct(z["m"].alias("m"), z["s"].alias("s"))).alias("scale"))  # an entry a place
    scaled = F.zip_with(values, "scale", lambda x, z: F.coalesce(F.try_divide(x - z["m"], z["s"]), F.lit(0.0)))
    return df.crossJoin(F.broadcast(scale)).select(id_, scaled.alias("vector"), F.col(values).alias("raw"))
