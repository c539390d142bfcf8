"""Wavelet power against a fast transform, and logarithms that close."""

import math
import random

import numpy as np

from isotrack.operators import spectra


def by_fft(values):
    n = len(values)
    t = np.arange(n)
    x = values - np.polyval(np.polyfit(t, values, 1), t)
    x = x / x.std(ddof=1)
    scales = 2 * 2.0 ** (np.arange(int(np.round(np.log2(n / 2) / 0.125)) + 1) * 0.125)
    omega = 2 * np.pi * np.arange(n) / n
    omega[n // 2 + 1 :] = 0
    power = [np.abs(np.fft.ifft(np.fft.fft(x) * np.sqrt(2 * np.pi * s) * np.pi**-0.25 * np.exp(-((s * omega - 6) ** 2) / 2) * (omega > 0))) ** 2 for s in scales]
    return np.array(power), scales * 4 * np.pi / (6 + np.sqrt(38)), np.corrcoef(x[:-1], x[1:])[0, 1]


def test_wavelet_power(spark):
    rng = np.random.default_rng(1)
    made = {"even": rng.normal(size=32), "odd": rng.normal(size=21).cumsum(), "wave": np.sin(2 * np.pi * np.arange(128) / 4) + 0.01 * np.arange(128)}
    rows = [(k, t, float(v)) for k, vs in made.items() for t, v in enumerate(vs)] + [("flat", t, 2.0 * t) for t in range(9)] + [("short", 0, 1.0), ("even", 99, None)]
    got = {}
    for r in spectra.wavelet_power(spark.createDataFrame(rows, "k string, year int, v double"), ["k"], "year", "v").collect():
        got[r.k, r.j, r.t] = r
    assert {k for k, _, _ in got} == set(made)
    for k, values in made.items():
        power, period, a = by_fft(values)
        n = len(values)
        assert sum(key[0] == k for key in got) == power.size
        for j in range(len(period)):
            level = (1 - a * a) / (1 - 2 * a * math.cos(2 * math.pi / period[j]) + a * a) * 2.995732273553991
            for t in range(n):
                r = got[k, j, t]
                assert abs(r.power - power[j, t]) < 1e-7 and abs(r.ratio - power[j, t] / level) < 1e-6
                assert r.inside == bool(period[j] <= max(min(t, n - 1 - t), 1e-5) * period[0] / 2 / math.sqrt(2) + 1e-9)
    mean = {j: np.mean([got["wave", j, t].power for t in range(128)]) for j in range(len(by_fft(made["wave"])[1]))}
    assert abs(got["wave", max(mean, key=mean.get), 0].period - 4) < 1


def test_log_sum(spark):
    rng = random.Random(2)
    rows = [(t % 12, t, c, *[math.exp(rng.gauss(0, 1)) if rng.random() > 0.1 else rng.choice([None, 0.0, float("nan"), -1.0]) for _ in range(3)]) for t in range(36) for c in range(4)]
    out = spectra.log_sum(spark.createDataFrame(rows, "month int, t int, cell int, a double, b double, c double"), ["cell"], "month", ["a", "b", "c"]).collect()
    whole = [r for r in rows if all(v is not None and v > 0 for v in r[3:])]
    assert len(out) == len(whole) and max(abs(r.residual) for r in out) < 1e-10
    own = {(r[2], r[1]): r for r in whole}
    for r in out:
        mine = [math.prod(q[3:]) for q in whole if q[2] == r.cell and q[0] == r.month]
        assert abs(r.total - (math.log(math.prod(own[r.cell, r.t][3:])) - np.mean(np.log(mine)))) < 1e-9
