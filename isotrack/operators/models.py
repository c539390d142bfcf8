"""Regression, clustering and signals: sums are aggregated in parallel, small systems are solved in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _products(df: DataFrame, cols: list[Column], weight: Column, right: Column) -> tuple[np.ndarray, np.ndarray]:
    """Weighted cross products of the columns and with ``right``: one small row, whatever the table."""
    k = len(cols)
    row = df.agg(*[F.sum(weight * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(weight * cols[i] * right).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)], float)


def glm(df: DataFrame, y: str, xs: list[str], family: str = "binomial", offset: str | None = None, steps: int = 25, tolerance: float = 1e-8) -> dict[str, float]:
    """Coefficients of a binomial (logit) or Poisson (log) model by iterated weighted least squares; each step is one aggregation."""
    df = df.na.drop(subset=[y, *xs, *([offset] if offset else [])])
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    off = F.col(offset) if offset else F.lit(0.0)
    beta = np.zeros(len(cols))
    for _ in range(steps):
        eta = off + sum((c * F.lit(float(b)) for c, b in zip(cols, beta)), F.lit(0.0))
        if family == "binomial":
            mu = 1 / (1 + F.exp(-eta))
            weight = F.greatest(mu * (1 - mu), F.lit(1e-10))
        elif family == "poisson":
            mu = F.exp(eta)
            weight = F.greatest(mu, F.lit(1e-10))
        else:
            raise ValueError(f"unknown family: {family}")
        a, b = _products(df, cols, weight, (F.col(y) - mu) / weight)
        step = np.linalg.lstsq(a, b, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return dict(zip(["const", *xs], beta.tolist()))


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """Variance inflation of each predictor: the diagonal of the inverse correlation matrix."""
    sums = df.na.drop(subset=xs).agg(*[F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i < j])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                r = np.array([[1.0 if i == j else row[f"r{min(i, j)}_{max(i, j)}"] for j in range(len(xs))] for i in range(len(xs))])
                yield pd.DataFrame({"term": xs, "vif": np.diag(np.linalg.inv(r))})

    return sums.mapInPandas(solve, "term string, vif double")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    by_chance = F.col("sa") * F.col("sb") / pairs(F.col("t"))
    return both.join(F.broadcast(rows)).join(F.broadcast(cols)).select(F.try_divide(F.col("s") - by_chance, (F.col("sa") + F.col("sb")) / 2 - by_chance).alias("ari"))


def fuzzy_centers(df: DataFrame, vector: str, start: np.ndarray, m: float = 2.0, steps: int = 50, tolerance: float = 1e-5) -> np.ndarray:
    """Centers of fuzzy c-means: tasks send sums per center, the driver holds centers alone."""
    centers, k, dim = np.asarray(start, float), *np.shape(start)
    for _ in range(steps):
        now = centers

        def sums(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            top, low = np.zeros((k, dim)), np.zeros(k)
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["v"])
                    d = np.maximum(((x[:, None, :] - now[None]) ** 2).sum(2), 1e-24) ** (-1 / (m - 1))
                    u = (d / d.sum(1, keepdims=True)) ** m
                    top, low = top + u.T @ x, low + u.sum(0)
            yield pd.DataFrame({"k": np.repeat(np.arange(k), dim), "d": np.tile(np.arange(dim), k), "top": top.ravel(), "low": np.repeat(low, dim)})

        parts = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).mapInPandas(sums, "k int, d int, top double, low double")
        rows = parts.groupBy("k", "d").agg((F.sum("top") / F.sum("low")).alias("c")).collect()
        centers = np.zeros((k, dim))
        for r in rows:
            centers[r["k"], r["d"]] = r["c"]
        if np.abs(centers - now).max() < tolerance:
            break
    return centers


def hac_regression(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str], lags: int = 3) -> DataFrame:
    """Least squares per short series with Newey-West errors: keys, term, coef, se."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", term string, coef double, se double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y, *xs]).sort_values(order)
        x = np.column_stack([np.ones(len(pdf)), pdf[xs].to_numpy(float)])
        inverse = np.linalg.pinv(x.T @ x)
        beta = inverse @ x.T @ pdf[y].to_numpy(float)
        g = x * (pdf[y].to_numpy(float) - x @ beta)[:, None]
        s = g.T @ g
        for lag in range(1, min(lags, len(g) - 1) + 1):
            c = g[lag:].T @ g[:-lag]
            s += (1 - lag / (lags + 1)) * (c + c.T)
        se = np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "term": ["const", *xs], "coef": beta, "se": se}) if len(pdf) else pd.DataFrame(columns=[*keys, "term", "coef", "se"])

    return df.groupBy(*keys).applyInPandas(solve, schema)


def wavelet_spectrum(df: DataFrame, keys: list[str], order: str, y: str, dj: float = 0.25, s0: float = 2.0) -> DataFrame:
    """Global Morlet spectrum of each short series (detrended, standardised): keys, period, power."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", period double, power double"

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y]).sort_values(order)
        n = len(pdf)
        if n < 4:
            return pd.DataFrame(columns=[*keys, "period", "power"])
        t, v = np.arange(n), pdf[y].to_numpy(float)
        v = v - np.polyval(np.polyfit(t, v, 1), t)
        v = v / (v.std() or 1.0)
        size = 1 << int(np.ceil(np.log2(n)))
        f = np.fft.fft(v, size)
        omega = 2 * np.pi * np.fft.fftfreq(size)
        scales = s0 * 2 ** (dj * np.arange(int(np.log2(n / s0) / dj) + 1))
        w0 = 6.0
        power = []
        for s in scales:
            psi = np.pi**-0.25 * np.sqrt(2 * np.pi * s) * np.exp(-((s * omega - w0) ** 2) / 2) * (omega > 0)
            power.append(float((np.abs(np.fft.ifft(f * psi)[:n]) ** 2).mean()))
        period = scales * 4 * np.pi / (w0 + np.sqrt(2 + w0**2))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "period": period, "power": power})

    return df.groupBy(*keys).applyInPandas(transform, schema)
