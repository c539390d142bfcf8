"""Bootstraps, label nulls, the period effect and advection against loops that read every row again."""

import itertools
import math
import random

import numpy as np
import pytest

from isotrack.operators import advection, contrast, resampled

YEARS = list(range(1, 13))
SCHEMA = "season int, period string"


@pytest.fixture(scope="module")
def years(spark):
    return spark.createDataFrame([(y, "e" if y <= 6 else "l") for y in YEARS], SCHEMA)


def arrays(weights):
    return {r.rep: (np.array(r.early), np.array(r.late)) for r in weights.collect()}


def test_year_weights(spark, years):
    for circular in (True, False):
        got = arrays(resampled.year_weights(years, 3, 40, 1, circular))
        assert sorted(got) == list(range(41))
        for rep, (e, w) in got.items():
            assert len(e) == len(w) == 12 and abs(e.sum() - 1) < 1e-12 and abs(w.sum() - 1) < 1e-12
            assert not e[6:].any() and not w[:6].any()
            if not circular:
                assert len({*e[:3]}) == len({*e[3:6]}) == 1
        assert np.allclose(got[0][0][:6], 1 / 6) and len({tuple(e) for e, _ in got.values()}) > 2
    with pytest.raises(ValueError):
        resampled.year_weights(years, 4, 5, 1, circular=False)
    gap = spark.createDataFrame([(1, "e"), (5, None), (9, "l")], SCHEMA)
    assert arrays(resampled.year_weights(gap, 3, 2, 1))[1][0].tolist() == [1, 0, 0]


def quantiles(values):
    return [np.quantile(values, q) for q in (0.025, 0.5, 0.975)]


def same(got, name, per):
    r = next(x for x in got if x.quantity == name)
    drawn = [per[k][name] for k in per if k and per[k]]
    assert r.n == len(drawn)
    assert np.allclose([r.observed, r.low, r.median, r.high], [per[0][name], *quantiles(drawn)], atol=1e-10)


def test_shapley_bootstrap(spark, years):
    rng = random.Random(3)
    rows, meta = [], []
    for sid in range(90):
        season, start = rng.choice(YEARS), rng.choice([0, 0, 1, 1, 2])
        cells = [rng.randrange(5) + start for _ in range(rng.randint(1, 6))]
        rows += [(sid, season, k, k, start, c) for k, c in enumerate(cells)]
        meta.append((season, start, np.bincount(cells, minlength=8) / len(cells)))
    df = spark.createDataFrame(rows, "sid int, season int, iso_time int, event_id int, start int, cell_id int")
    weights = resampled.year_weights(years, 3, 60, 2)
    per = {}
    for rep, halves in arrays(weights).items():
        g, q, n = [], [], []
        for w in halves:
            mass = np.array([w[s - 1] / sum(m[0] == s for m in meta) for s, _, _ in meta])
            g.append({b: mass[[m[1] == b for m in meta]].sum() for b in range(3)})
            n.append({b: sum(m[1] == b and x > 0 for m, x in zip(meta, mass)) for b in range(3)})
            q.append({b: sum((x * m[2] for m, x in zip(meta, mass) if m[1] == b), np.zeros(8)) / g[-1][b] if g[-1][b] else None for b in range(3)})
        bins = [b for b in range(3) if n[0][b] >= 3 and n[1][b] >= 3]
        if not bins:
            per[rep] = None
            continue
        cover = [sum(x[b] for b in bins) for x in g]
        (ge, gl), (qe, ql) = [np.array([x[b] for b in bins]) / c for x, c in zip(g, cover)], [np.stack([x[b] for b in bins]) for x in q]
        total, gen, prop = gl @ ql - ge @ qe, (gl - ge) @ (qe + ql) / 2, (ge + gl) @ (ql - qe) / 2
        per[rep] = {"total_tv": abs(total).sum() / 2, "genesis_fraction": gen @ total / (total @ total), "propagation_fraction": prop @ total / (total @ total), "early_coverage": cover[0], "late_coverage": cover[1]}
    got = resampled.shapley_bootstrap(df, weights).collect()
    for name in per[0]:
        same(got, name, per)


def test_between_and_exposure_bootstrap(spark, years):
    rng = np.random.default_rng(4)
    joint = rng.dirichlet(np.ones(12), len(YEARS)).reshape(-1, 3, 4)
    joint[2, 1] = 0
    joint /= joint.sum((1, 2), keepdims=True)
    df = spark.createDataFrame([(y, g, c, float(joint[i, g, c])) for i, y in enumerate(YEARS) for g in range(3) for c in range(4) if joint[i, g, c]], "season int, g int, cell_id int, share double")
    weights = resampled.year_weights(years, 2, 50, 5, circular=False)
    per = {}
    for rep, (e, w) in arrays(weights).items():
        je, jl = np.tensordot(e, joint, 1), np.tensordot(w, joint, 1)
        pe, pl = je.sum(1, keepdims=True), jl.sum(1, keepdims=True)
        d = (jl - je).sum(0)
        between, within = ((pl - pe) * (je / pe + jl / pl) / 2).sum(0), ((pe + pl) / 2 * (jl / pl - je / pe)).sum(0)
        assert np.allclose(between + within, d)
        per[rep] = {"between_share": between @ d / (d @ d), "within_share": within @ d / (d @ d), "total_variation": abs(d).sum() / 2}
    got = resampled.between_bootstrap(df, weights, "g").collect()
    for name in per[0]:
        same(got, name, per)

    w, h = rng.dirichlet(np.ones(5), len(YEARS)), rng.normal(20, 5, (len(YEARS), 5))
    state = spark.createDataFrame([(y, c, float(w[i, c]), float(h[i, c])) for i, y in enumerate(YEARS) for c in range(5)], "season int, cell_id int, w double, h double")
    weights = resampled.year_weights(years, 3, 50, 6)
    per = {}
    for rep, (e, late) in arrays(weights).items():
        (w1, h1, x1), (w2, h2, x2) = ((k @ w, k @ h, k @ (w * h)) for k in (e, late))
        parts = {"delta": (x2 - x1).sum(), "redistribution": ((w2 - w1) * (h1 + h2) / 2).sum(), "state_change": ((w1 + w2) / 2 * (h2 - h1)).sum()}
        per[rep] = parts | {"covariation": parts["delta"] - parts["redistribution"] - parts["state_change"]}
    got = resampled.exposure_bootstrap(state, weights).collect()
    for name in per[0]:
        same(got, name, per)
    seen = contrast.exposure_change(state, (1, 6), (7, 12)).first()
    assert abs(seen.redistribution - next(r.observed for r in got if r.quantity == "redistribution")) < 1e-9


def test_label_permutation(spark):
    rng = random.Random(7)
    entities = [(y, s, rng.choice("abc"), rng.randrange(4)) for y in range(1, 7) for s in range(9)]
    fields = [(y, s, c + (ord(k) - 97), x) for y, s, k, c in entities for c, x in ((c, 0.75), (c + 1, 0.25))]
    period = {y: "e" if y <= 3 else "l" for y in range(1, 7)}
    f = spark.createDataFrame(fields, "season int, sid int, cell_id int, share double")
    g = spark.createDataFrame([(y, s, period[y], k) for y, s, k, _ in entities], "season int, sid int, period string, label string")
    got = resampled.label_permutation(f, g, 99, 3).first()
    assert np.allclose(got, resampled.label_permutation(f.repartition(3), g, 99, 3).first(), atol=1e-12)

    import hashlib

    def share(given):
        j = {p: np.zeros((3, 8)) for p in "el"}
        for y, s, c, x in fields:
            j[period[y]]["abc".index(given[y, s]), c] += x / 27
        pe, pl = (np.array([[sum(k == lab and period[y] == p for y, _, k, _ in entities) / 27] for lab in "abc"]) for p in "el")
        d = (j["l"] - j["e"]).sum(0)
        return ((pl - pe) * (j["e"] / pe + j["l"] / pl) / 2).sum(0) @ d / (d @ d)

    seen = share({(y, s): k for y, s, k, _ in entities})
    null = []
    for rep in range(1, 100):
        given = {}
        for y in range(1, 7):
            mine = sorted((s, k) for yy, s, k, _ in entities if yy == y)
            order = sorted(range(9), key=lambda s: hashlib.md5(f"3_{rep}_{y}_{s}".encode()).hexdigest())
            given |= {(y, s): mine[i][1] for i, s in enumerate(order)}
        null.append(share(given))
    assert np.allclose([got.observed, got["mean"], got.sd, got.low, got.median, got.high], [seen, np.mean(null), np.std(null, ddof=1), *quantiles(null)])
    lower, upper = ((1 + sum(round(a, 9) <= round(seen, 9) for a in null)) / 100, (1 + sum(round(a, 9) >= round(seen, 9) for a in null)) / 100)
    assert (got.p_lower, got.p_upper, got.p_two_sided) == (lower, upper, min(1, 2 * min(lower, upper))) and got.n == 99


def fitted(y, z, q):
    m = np.eye(len(y)) - z @ np.linalg.pinv(z)
    r, e = m @ y, m @ q
    b = e @ r / (e @ e)
    ss = ((np.outer(e, b)) ** 2).sum()
    rest = ((r - np.outer(e, b)) ** 2).sum()
    return ss / (rest / (len(y) - z.shape[1] - 1)), ss / (ss + rest), y - r, r


def test_period_effect(spark):
    rng = np.random.default_rng(8)
    n = 7
    q, x = np.array([0, 0, 0, 0, 1, 1, 1.0]), rng.normal(size=n)
    y = rng.random((n, 5)) + np.outer(q, [0.5, 0, 0, 0, 0.2])
    y[y < 0.2] = 0
    z = np.column_stack([np.ones(n), x])
    responses = spark.createDataFrame([(i, c, float(y[i, c])) for i in range(n) for c in range(5) if y[i, c]], "season int, cell_id int, v double")
    table = spark.createDataFrame([(i, float(x[i]), float(q[i])) for i in range(n)], "season int, x double, late double")
    blocks = spark.createDataFrame([(i, i) for i in range(n)], "season int, block int")
    got = resampled.freedman_lane(responses, table, ["x"], "late", blocks, 299, 11).first()
    f, r2, base, resid = fitted(y, z, q)
    assert abs(got.f - f) < 1e-8 and abs(got.partial_r2 - r2) < 1e-10
    exact = [fitted(base + resid[list(o)], z, q)[0] for o in itertools.permutations(range(n))]
    share = np.mean([round(v, 7) >= round(f, 7) for v in exact])
    assert abs(got.p_value - share) < 4 * math.sqrt(share * (1 - share) / 300) + 1 / 300


def test_advection(spark):
    rng = random.Random(9)
    field = {(m, r, c): (rng.uniform(-9, 9), rng.uniform(-6, 9)) for m in "ab" for r in range(4) for c in range(6)}
    del field["a", 1, 2]
    seeds = [(i, rng.choice("ab"), rng.uniform(0, 20), rng.uniform(98, 127), rng.randint(0, 15)) for i in range(40)] + [(90, "c", 10.0, 110.0, 4), (91, "a", None, 110.0, 4)]
    box, want = (100.0, 125.0, 0.0, 18.0), set()
    for i, m, la, lo, steps in seeds:
        for k in range(steps):
            if la is None or not (box[0] <= lo <= box[1] and box[2] <= la <= box[3]):
                break
            want.add((i, k, round(la, 7), round(lo, 7)))
            r, c = math.floor(la / 5), math.floor((lo - 100) / 5)
            corners = [field.get((m, r + a, c + b)) for a in (0, 1) for b in (0, 1)]
            if None in corners:
                break
            wy, wx = la / 5 - r, (lo - 100) / 5 - c
            u, v = (sum(x[p] * w for x, w in zip(corners, ((1 - wy) * (1 - wx), (1 - wy) * wx, wy * (1 - wx), wy * wx))) for p in (0, 1))
            lo, la = lo + math.degrees((0.7 * u - 1) * 21600 / (6371000 * math.cos(math.radians(la)))), la + math.degrees((0.7 * v + 2) * 21600 / 6371000)
    s = spark.createDataFrame(seeds, "id int, m string, lat double, lon double, steps int")
    g = spark.createDataFrame([(*k, *v) for k, v in field.items()], "m string, row int, col int, u double, v double")
    got = advection.advect(s, g, ["id"], ["m"], 0.0, 100.0, 5.0, box, 0.7, -1.0, 2.0).collect()
    assert {(r.id, r.k, round(r.lat, 7), round(r.lon, 7)) for r in got} == want and len(got) == len(want)
    assert max(r.k for r in got) > advection.CHUNK
    assert advection.advect(s.where("false"), g, ["id"], ["m"], 0.0, 100.0, 5.0, box).count() == 0


def test_remapped_steps(spark):
    rng = random.Random(10)
    target, donor = [(i, rng.randint(1, 9)) for i in range(23)], [(i, rng.randint(3, 40)) for i in range(11)]
    got = {r.id: r.steps for r in advection.remapped_steps(spark.createDataFrame(target, "id int, steps int"), spark.createDataFrame(donor, "id int, steps int"), ["id"]).collect()}
    for r, (i, _) in enumerate(sorted(target, key=lambda x: (x[1], x[0]))):
        assert got[i] == max(1, round(float(np.quantile([v for _, v in donor], (r + 0.5) / 23))))
