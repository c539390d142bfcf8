"""Ridge, regression tables, generalized linear models and clusterings against direct solutions."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from isotrack.operators import fits


def test_ridge_time_folds(spark):
    rng = np.random.default_rng(1)
    made = {}
    for key, n in (("a", 41), ("b", 17), ("c", 5)):
        x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 100, 3]
        made[key] = (x, x @ [1, 0.1, 2] + rng.normal(size=n) * (0.3 if key == "a" else 4))
    rows = [(k, t, *map(float, x[t]), float(y[t])) for k, (x, y) in made.items() for t in range(len(y))] + [("a", 99, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, u double, v double, w double, y double").repartition(3)
    got = {}
    for r in fits.ridge_time_folds(df, ["k"], "t", "y", ["u", "v", "w"]).collect():
        got.setdefault(r.k, {})[r.term] = r
    assert set(got) == {"a", "b"}
    for k in got:
        x, y = made[k]
        n = len(y)
        x, y = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
        folds = min(5, max(2, n // 8))
        size = n // (folds + 1)

        def solve(a, b, alpha):
            c = a - a.mean(0)
            beta = np.linalg.solve(c.T @ c + alpha * np.eye(3), c.T @ (b - b.mean()))
            return b.mean() - a.mean(0) @ beta, beta

        scores = []
        for alpha in fits.ALPHAS:
            each = []
            for i in range(folds):
                cut = n - (folds - i) * size
                const, beta = solve(x[:cut], y[:cut], alpha)
                test = y[cut : cut + size]
                each.append(1 - ((test - const - x[cut : cut + size] @ beta) ** 2).sum() / ((test - test.mean()) ** 2).sum())
            scores.append(np.mean(each))
        alpha = fits.ALPHAS[int(np.argmax(scores))]
        assert got[k]["u"].alpha == pytest.approx(alpha) and got[k]["u"].folds == folds and got[k]["u"].n == n
        assert np.allclose([got[k][t].coef for t in "uvw"], solve(x, y, alpha)[1])


def test_regression_table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 2))
    y = x @ [1, -0.5] + rng.normal(size=30)
    df = spark.createDataFrame([("s", t, *map(float, x[t]), float(y[t])) for t in range(30)], "k string, t int, a double, b double, y double")
    got = {r.term: r for r in fits.regression_table(df, ["k"], "t", "y", ["a", "b"]).collect()}
    z = np.column_stack([np.ones(30), (x - x.mean(0)) / x.std(0, ddof=1)])
    v = (y - y.mean()) / y.std(ddof=1)
    beta = np.linalg.lstsq(z, v, rcond=None)[0]
    e = v - z @ beta
    g = z * e[:, None]
    s = g.T @ g + sum((1 - k / 4) * (g[k:].T @ g[:-k] + g[:-k].T @ g[k:]) for k in (1, 2, 3))
    inverse = np.linalg.inv(z.T @ z)
    se = np.sqrt(np.diag(inverse @ s @ inverse))
    loglik = -15 * (math.log(2 * math.pi) + math.log((e @ e) / 30) + 1)
    for i, t in enumerate(["const", "a", "b"]):
        r = got[t]
        assert np.allclose([r.coef, r.se], [beta[i], se[i]])
        assert abs(r.p - 2 * (1 - NormalDist().cdf(abs(beta[i] / se[i])))) < 1e-7
        assert np.allclose([r.r2, r.adjusted_r2, r.aic, r.bic], [1 - e @ e / 29, 1 - (e @ e / 27) / (v @ v / 29), 6 - 2 * loglik, 3 * math.log(30) - 2 * loglik])
        assert r.low < r.coef < r.high and r.n == 30


def newton(x, y, mean, weight):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = mean(x @ beta)
        beta = beta + np.linalg.solve(x.T @ (x * weight(mu)[:, None]), x.T @ (y - mu))
    return beta


def test_binomial_with_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(200), rng.normal(size=200)])
    group = rng.integers(0, 12, 200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [0.3, 0.8] + 0.5 * rng.normal(size=12)[group])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x[:, 1], y, group)] + [(None, 1.0, 1)], "x double, y double, g int")
    got = {r.term: r for r in fits.glm_table(df, "y", ["x"], "binomial", cluster="g").collect()}
    beta = newton(x, y, lambda e: 1 / (1 + np.exp(-e)), lambda m: m * (1 - m))
    mu = 1 / (1 + np.exp(-x @ beta))
    inverse = np.linalg.inv(x.T @ (x * (mu * (1 - mu))[:, None]))
    s = np.array([(x * (y - mu)[:, None])[group == k].sum(0) for k in range(12)])
    se = np.sqrt(np.diag(inverse @ (s.T @ s) @ inverse * 12 / 11 * 199 / 198))
    for i, t in enumerate(("const", "x")):
        assert np.allclose([got[t].coef, got[t].se], [beta[i], se[i]], atol=1e-7) and got[t].clusters == 12 and got[t].n == 200
        assert abs(got[t].p - 2 * (1 - NormalDist().cdf(abs(beta[i] / se[i])))) < 1e-6
    own = {r.term: r for r in fits.glm_table(df, "y", ["x"], "binomial").collect()}
    assert np.allclose(own["x"].se, math.sqrt(inverse[1, 1]), atol=1e-7) and own["x"].clusters is None
    with pytest.raises(ValueError):
        fits.glm_table(df, "y", ["x"], "gamma")


def test_poisson_and_negative_binomial(spark):
    rng = np.random.default_rng(4)
    n = 90
    x, off = np.column_stack([np.ones(n), rng.normal(size=n)]), np.log(rng.uniform(1, 5, n))
    for heavy in (False, True):
        mu = np.exp(x @ [0.5, 0.3] + off)
        y = rng.poisson(mu * rng.gamma(1.5, 1 / 1.5, n) if heavy else mu).astype(float)
        df = spark.createDataFrame([(t, float(a), float(b), float(o)) for t, (a, b, o) in enumerate(zip(x[:, 1], y, off))], "t int, x double, y double, o double")
        got = {r.term: r for r in fits.glm_table(df, "y", ["x"], "poisson", "o", cluster="t", lags=3).collect()}
        r = got["x"]
        assert r.family == ("negative_binomial" if heavy else "poisson") and (r.chi2_df > 1.5) == heavy
        beta = np.array([got["const"].coef, r.coef])
        mu = np.exp(x @ beta + off)
        variance = mu + r.dispersion * mu**2
        assert np.abs(x.T @ ((y - mu) * mu / variance)).max() < 1e-5
        if heavy:
            assert abs(((y - mu) ** 2 / variance).sum() / (n - 2) - 1) < 1e-5
        g = x * ((y - mu) * mu / variance)[:, None]
        s = g.T @ g + sum((1 - k / 4) * (g[k:].T @ g[:-k] + g[:-k].T @ g[k:]) for k in (1, 2, 3))
        inverse = np.linalg.inv(x.T @ (x * (mu * mu / variance)[:, None]))
        assert np.allclose([got["const"].se, r.se], np.sqrt(np.diag(inverse @ s @ inverse)), atol=1e-6)


def test_cluster_scan(spark):
    rng = np.random.default_rng(5)
    places = np.array([[0, 0], [8, 0], [0, 9]])
    x = np.vstack([p + rng.normal(size=(12, 2)) * 0.5 for p in places])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, v array<double>").repartition(3)
    found, centers = fits.cluster_scan(df, "id", "v", [2, 3, 4], 3)
    rows = found.collect()
    assert len(rows) == 9 and [r.k for r in rows if r.selected] == [3] and sum(r.best_of_k for r in rows) == 3
    assert all(r.ari == pytest.approx(1) for r in rows if r.best_of_k) and all(r.iterations < 1000 for r in rows)
    assert max(min(np.linalg.norm(c - p) for c in centers) for p in places) < 0.5
    # the memberships of converged centers give the centers back, and the index is theirs
    d = ((x[:, None] - centers[None]) ** 2).sum(2)
    u = (1 / d) / (1 / d).sum(1, keepdims=True)
    assert np.allclose((u.T**2 @ x) / (u**2).sum(0)[:, None], centers, atol=1e-4)
    apart = ((centers[:, None] - centers[None]) ** 2).sum(2)
    best = next(r for r in rows if r.selected)
    assert best.xb == pytest.approx((u**2 * d).sum() / (36 * apart[apart > 0].min()), rel=1e-5) and best.fpc == pytest.approx((u * u).sum() / 36, rel=1e-6)
    again, _ = fits.cluster_scan(df.repartition(1), "id", "v", [2, 3, 4], 3)
    assert [(r.k, r.seed, round(r.xb, 8), r.selected) for r in again.collect()] == [(r.k, r.seed, round(r.xb, 8), r.selected) for r in rows]
    with pytest.raises(ValueError):
        fits.cluster_scan(df.where("false"), "id", "v", [2], 1)


def test_cluster_scan_query_runs_until_fits_settle(spark):
    """Every fit of the query is that of a plain loop with the survey's 1,000 steps and 1e-5."""
    from isotrack.plans.catalog import QUERIES
    from isotrack.plans.fits import shapes

    d = "/root/testdata/sf0.001"
    rows = shapes(spark, d).select("sid", "vector").collect()
    ids, x = np.array([r.sid for r in rows]), np.array([r.vector for r in rows])
    got = {(r.k, r.seed): r for r in QUERIES["cluster_scan"](spark, d).collect()}
    assert len(got) == 100 and sum(r.selected for r in got.values()) == 1
    longest = 0
    for (k, seed), r in got.items():
        u, centers, step = fits.Fits([(k, seed)]).dealt(ids), np.zeros((k, 40)), 0
        while step < 1000:
            before, centers = centers, ((u**2).T @ x) / (u**2).sum(0)[:, None]
            gaps = np.maximum(((x[:, None] - centers[None]) ** 2).sum(2), 1e-24)
            u, step = (1 / gaps) / (1 / gaps).sum(1, keepdims=True), step + 1
            if step > 1 and np.abs(centers - before).max() < 1e-5:
                break
        longest = max(longest, step)
        apart = ((centers[:, None] - centers[None]) ** 2).sum(2)
        assert r.xb == pytest.approx((u**2 * gaps).sum() / (len(x) * apart[apart > 0].min()), abs=1e-3, rel=1e-3), (k, seed)
        assert r.fpc == pytest.approx((u * u).sum() / len(x), abs=2e-4), (k, seed)
    assert longest > 60


def test_standard_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, x array<double>")
    got = {r.id: (r.vector, r.raw) for r in fits.standard_vectors(df, "id", "x").collect()}
    assert got == {1: ([-1.0, 0.0], [1.0, 5.0]), 2: ([1.0, 0.0], [3.0, 5.0])}
