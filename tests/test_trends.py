"""Trend rows against direct computation from the published formulas."""

import math
import random
from statistics import NormalDist, median

from pyspark.sql import functions as F

from isotrack.functions import tails
from isotrack.operators import trends


def by_hand(years, values):
    n, at = len(values), sorted(range(len(values)), key=lambda i: years[i])
    x, y = [years[i] for i in at], [values[i] for i in at]
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    slopes = sorted((y[j] - y[i]) / (x[j] - x[i]) for i, j in pairs)
    tie = sum((k - 1) * (2 * k + 5) for k in (y.count(v) for v in y))
    sigma = math.sqrt((n * (n - 1) * (2 * n + 5) - tie) / 18)
    z0 = NormalDist().inv_cdf(0.975)
    low, high = slopes[max(round((len(slopes) - z0 * sigma) / 2) - 1, 0)], slopes[min(round((len(slopes) + z0 * sigma) / 2), len(slopes) - 1)]
    s = sum((y[j] > y[i]) - (y[j] < y[i]) for i, j in pairs)
    step = median((y[j] - y[i]) / (j - i) for i, j in pairs)
    d = [round(v - (i + 1) * step, 9) for i, v in enumerate(y)]
    ranks = [sum(e < v for e in d) + (d.count(v) + 1) / 2 - (n + 1) / 2 for v in d]
    extra = 0
    for k in range(1, n):
        r = sum(a * b for a, b in zip(ranks, ranks[k:])) / sum(a * a for a in ranks)
        if abs(r) > z0 / math.sqrt(n):
            extra += (n - k) * (n - k - 1) * (n - k - 2) * r
    variance = (n * (n - 1) * (2 * n + 5) - tie) / 18 * (1 + 2 / (n * (n - 1) * (n - 2)) * extra)
    if variance <= 0:
        return median(slopes), low, high, s, None
    z = (s - (s > 0) + (s < 0)) / math.sqrt(variance)
    return median(slopes), low, high, s, 2 * (1 - NormalDist().cdf(abs(z)))


def test_trend_summary(spark):
    rng = random.Random(0)
    made = {"up": [0.5 * t + rng.gauss(0, 1) for t in range(45)], "ties": [float(rng.randint(0, 3)) for _ in range(30)], "flat": [1.0] * 9, "four": [1.0, 2.0, 3.0, 5.0], "five": [3.0, 1.0, 4.0, 1.5, 9.0]}
    walk = [0.0]
    for _ in range(59):
        walk.append(0.8 * walk[-1] + rng.gauss(0, 1))
    made["walk"] = walk
    rows = [(k, 1980 + t, v) for k, values in made.items() for t, v in enumerate(values)]
    rows += [("up", 2100, None), ("up", 2101, float("nan")), ("gone", 1, None)]
    rng.shuffle(rows)
    got = {r.k: r for r in trends.trend_summary(spark.createDataFrame(rows, "k string, year int, v double"), ["k"], "year", "v").collect()}
    assert set(got) == set(made)
    for k, values in made.items():
        r = got[k]
        assert r.n == len(values) and abs(r["mean"] - sum(values) / len(values)) < 1e-9
        if k in ("flat", "four"):
            assert (r.slope, r.low, r.high, r.mk_s, r.z, r.p, r.trend) == (None,) * 7
            continue
        slope, low, high, s, p = by_hand([1980 + t for t in range(len(values))], values)
        assert all(abs(a - b) < 1e-9 for a, b in ((r.slope, slope), (r.low, low), (r.high, high), (r.mk_s, s)))
        assert r.p == p or abs(r.p - p) < 1e-8
        assert r.low <= r.slope <= r.high
    assert got["up"].trend == "increasing" and 0.3 < got["up"].slope < 0.7 and got["ties"].trend == "no trend"


def test_trend_rows(spark):
    rng = random.Random(1)
    rows = [(k, t, s * t + rng.gauss(0, 1)) for k, s in (("a", 0.5), ("b", 0.0), ("c", -0.4)) for t in range(1980, 2010)] + [("short", 1990, 1.0)]
    df = spark.createDataFrame(rows, "k string, year int, v double").withColumn("f", F.lit("one"))
    first, again = (sorted(trends.trend_rows(df, ["f", "k"], ["f"], "year", "v", 3, 99, 42).collect()) for _ in range(2))
    assert first == again
    got = {r.k: r for r in first}
    assert got["short"].n == 1 and got["short"].p is None and got["short"].q is None and got["short"].low_decade is None
    for k in "abc":
        assert got[k].low_decade < got[k].slope_decade < got[k].high_decade and (got[k].start, got[k].end) == (1980, 2009)
        assert got[k].q >= got[k].p
    assert [got[k].trend for k in "abc"] == ["increasing", "no trend", "decreasing"]


def test_tails(spark):
    t = spark.createDataFrame([(0.0, 5.0), (1.96, 1.0), (-2.5, 3.7), (4.0, 28.0), (40.0, 60.0), (None, 2.0)], "t double, df double")
    got = t.select("t", "df", tails.normal_two_sided(F.col("t")).alias("n"), tails.student_two_sided(F.col("t"), F.col("df")).alias("s")).collect()
    from isotrack.operators.inference import student_p

    for r in got:
        if r.t is None:
            assert r.n is None and r.s is None
        else:
            assert abs(r.n - 2 * (1 - NormalDist().cdf(abs(r.t)))) < 1e-9
            assert abs(r.s - student_p(abs(r.t), r.df)) < 1e-7
    assert abs(got[1].s - 0.3004) < 1e-3  # tables
