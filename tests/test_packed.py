"""Field tests, area significance, projections from products of years and their calibration, against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from isotrack.operators import contrast, inference, packed

N, BLOCK = 12, 3


def blocks(spark):
    return spark.createDataFrame([(y, y // BLOCK) for y in range(N)], "season int, block int")


def some_field():
    rng = random.Random(2)
    x = [rng.gauss(0, 1) for _ in range(N)]
    field = {(5.0 * i, j): {y: rng.gauss(0, 1) + (x[y] if i == 0 else 0) for y in range(N)} for i in range(4) for j in range(3)}
    del field[5.0, 1][3], field[5.0, 1][4]
    field[10.0, 2] = dict.fromkeys(range(N), 7.0)
    field[15.0, 0][0] = None
    return x, field


def frame(spark, field):
    return spark.createDataFrame([(lat, j, y, v) for (lat, j), vs in field.items() for y, v in vs.items()], "lat double, lon int, season int, v double")


def test_field_tests(spark):
    x, field = some_field()
    series = spark.createDataFrame(list(enumerate(x)), "season int, x double")
    cells, whole = packed.field_tests(frame(spark, field), ["lat", "lon"], series, blocks(spark), "x", "v", 99, 4)
    _, positions = packed.shuffled_positions(blocks(spark), 99, 4)
    moved = {(r.rep, r.season): r.position for r in inference.block_positions(blocks(spark), 99, 4).collect()}
    assert all(positions[rep, y] == p for (rep, y), p in moved.items())

    def corr(vs, rep):
        years = [y for y, v in vs.items() if v is not None]
        a, b = np.array([x[positions[rep, y]] for y in years]), np.array([vs[y] for y in years])
        return 0.0 if not b.std() else float(np.corrcoef(a, b)[0, 1])

    got = {(r.lat, r.lon): r for r in cells.collect()}
    r2 = np.zeros(100)
    for key, vs in field.items():
        r = [corr(vs, rep) for rep in range(100)]
        r2 += np.square(r) / len(field)
        assert abs(got[key].r - r[0]) < 1e-9
        assert got[key].p == (1 + sum(round(abs(v), 9) >= round(abs(r[0]), 9) for v in r[1:])) / 100
    assert got[10.0, 2].r == 0 and got[10.0, 2].p == 1 and got[10.0, 2].beta == 0
    out = whole.first()
    assert abs(out.global_r2 - r2[0]) < 1e-9 and out.p_value == (1 + sum(r2[1:].round(9) >= r2[0].round(9))) / 100
    ps = sorted((r.p, k) for k, r in got.items())
    for i, (p, k) in enumerate(ps):
        assert abs(got[k].q - min(1, min(ps[j][0] * len(ps) / (max(m for m, (o, _) in enumerate(ps) if o == ps[j][0]) + 1) for j in range(i, len(ps))))) < 1e-12
    assert packed.field_tests(frame(spark, {}), ["lat", "lon"], series, blocks(spark), "x", "v", 9, 4)[0].count() == 0


def test_area_significance(spark):
    x, field = some_field()
    label = ["one" if v > 0.4 else "two" if v < -0.4 else "rest" for v in x]
    labels = spark.createDataFrame(list(enumerate(label)), "season int, label string")
    cells, whole = packed.area_significance(frame(spark, field), ["lat", "lon"], "lat", labels, blocks(spark), "v", 99, 4, "one", "two")
    _, positions = packed.shuffled_positions(blocks(spark), 99, 4)

    def difference(vs, rep):
        side = [[v for y, v in vs.items() if v is not None and label[positions[rep, y]] == k] for k in ("one", "two")]
        return round(np.mean(side[0]) - np.mean(side[1]), 9)

    got, area = {(r.lat, r.lon): r for r in cells.collect()}, np.zeros(100)
    for key, vs in field.items():
        d = np.array([difference(vs, rep) for rep in range(100)])
        low, high = np.percentile(d[1:], [2.5, 97.5]).round(9)
        area += math.cos(math.radians(key[0])) * ((d < low) | (d > high))
        assert np.allclose([got[key].difference, got[key].low, got[key].high], [d[0], low, high], atol=2e-9)
        assert got[key].outside == bool(d[0] < low or d[0] > high)
    out = whole.first()
    assert abs(out.area - area[0]) < 1e-9 and out.p_value == (1 + sum(area[1:].round(6) >= area[0].round(6))) / 100


def test_projection_from_products_of_years(spark):
    rng = np.random.default_rng(5)
    f = rng.dirichlet(np.ones(7), N)
    f[3, 2] = 0
    rows = [(0, y, "e" if y < 6 else "l", c, float(f[y, c])) for y in range(N) for c in range(7)]
    shares = spark.createDataFrame(rows, "rep int, season int, period string, cell_id int, share double")
    late = np.arange(N) >= 6
    scores = packed.left_out_scores(f @ f.T, late)
    wide = {r.season: r.score for r in contrast.leave_one_out_scores(shares).collect()}
    assert np.allclose([wide[y] for y in range(N)], scores)
    sparse = shares.where("share > 0").select("season", "cell_id", "share")
    got = packed.projection_permutation(sparse, blocks(spark), 6, 99, 4).first()
    _, positions = packed.shuffled_positions(blocks(spark), 99, 4)
    d = [packed.separation(packed.left_out_scores(f @ f.T, p >= 6), p >= 6) for p in positions]
    assert abs(got.separation - d[0]) < 1e-9 and got.p_value == (1 + sum(round(abs(v), 7) >= round(abs(d[0]), 7) for v in d[1:])) / 100

    trials = spark.createDataFrame([(t, y, c, float(v)) for t in range(6) for y, row in enumerate(rng.dirichlet(np.ones(5), N)) for c, v in enumerate(row)], "trial int, season int, cell_id int, share double")
    found = packed.null_calibration(trials, blocks(spark), 6, 19, 8)
    ps = found.collect()
    assert len(ps) == 6 and all(0.05 <= r.fixed_p <= 1 and 0.05 <= r.refit_p <= 1 for r in ps)
    rates = {r.statistic: r for r in packed.rejection_rates(found).collect()}
    assert rates["fixed_p"].trials == 6 and rates["refit_p"].at_10 == np.mean([r.refit_p <= 0.1 for r in ps])


def test_bh_fdr_families(spark):
    rows = [("a", 0.01), ("a", 0.04), ("a", None), ("a", 0.03), ("b", 0.5), (None, 0.2), (None, 0.2), ("c", None)]
    got = sorted(((r.f or "", r.p or 2, r.q) for r in inference.bh_fdr(spark.createDataFrame(rows, "f string, p double"), "p", ["f"]).collect()), key=str)
    want = [("", 0.2, 0.2), ("", 0.2, 0.2), ("a", 0.01, 0.03), ("a", 0.03, 0.04), ("a", 0.04, 0.04), ("a", 2, None), ("b", 0.5, 0.5), ("c", 2, None)]
    assert [(f, p, q and round(q, 9)) for f, p, q in got] == want


def test_series_and_cutpoints(spark):
    rng = np.random.default_rng(6)
    made = {"a": rng.normal(size=N) + (np.arange(N) >= 6), "b": rng.normal(size=N)}
    rows = [(k, y, float(v)) for k, vs in made.items() for y, v in enumerate(vs)] + [("c", 0, 1.0), ("c", 1, 2.0)]
    rows[3] = ("a", 3, None)
    made["a"][3] = np.nan
    series = spark.createDataFrame(rows, "k string, season int, v double")
    _, positions = packed.shuffled_positions(blocks(spark), 99, 4)
    got = {(r.k, r.n_early): r for r in packed.series_permutation(series, ["k"], "v", blocks(spark), [4, 6], 99, 4).collect()}
    assert len(got) == 6 and got["c", 4].difference is None and got["c", 4].p_value is None
    for k, v in made.items():
        for n in (4, 6):
            d = np.array([np.nanmean(v[p >= n]) - np.nanmean(v[p < n]) for p in positions])
            assert abs(got[k, n].difference - d[0]) < 1e-9
            assert got[k, n].p_value == (1 + sum(np.abs(d[1:]).round(9) >= np.abs(d[0]).round(9))) / 100

    f = rng.dirichlet(np.ones(9), N)
    f[2, :3] = 0
    shares = spark.createDataFrame([(y, c, float(f[y, c])) for y in range(N) for c in range(9) if f[y, c]], "season int, cell_id int, share double")
    for r in packed.cutpoint_fields(shares, blocks(spark), [4, 7], 99, 4).collect():
        tv = np.array([np.abs(f[p >= r.n_early].mean(0) - f[p < r.n_early].mean(0)).sum() / 2 for p in positions])
        assert abs(r.tv - tv[0]) < 1e-9 and r.p_value == (1 + sum(tv[1:].round(9) >= tv[0].round(9))) / 100


def test_numbered(spark):
    from isotrack.operators import joins, tracks

    rng = random.Random(3)
    rows = [(i, rng.randrange(40)) for i in range(500)]
    frame = spark.createDataFrame(rows, "sid int, v int").repartition(7)
    assert {r.sid: r.at for r in joins.numbered(frame, ["v", "sid"], "at").collect()} == {sid: i for i, (v, sid) in enumerate(sorted((v, sid) for sid, v in rows))}
    assert [(r.v, r.key_id) for r in joins.dense_keys(frame, ["v"]).orderBy("v").collect()] == [(v, i) for i, v in enumerate(sorted({v for _, v in rows}))]
    assert joins.dense_keys(frame.where("false"), ["v"]).count() == 0
    donor = spark.createDataFrame([(i, x) for i, x in enumerate([5, 1, 9])], "sid int, v int")
    got = {r.sid: r.remapped for r in tracks.rank_remap(frame.where("sid < 4"), donor, "v").collect()}
    order = sorted(range(4), key=lambda i: (rows[i][1], i))
    assert all(abs(got[sid] - np.quantile([1, 5, 9], (k + 0.5) / 4)) < 1e-12 for k, sid in enumerate(order))


def test_dealt_counts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") != 7, F.col("id") * 977).alias("event_id"), (F.col("id") % 11).cast("int").alias("cell_id")).repartition(3)
    years = [1, 2, 5, 9, 30]
    got = {tuple(r) for r in packed.dealt_counts(rows, "event_id", years, 8).collect()}
    long = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(7))))
    long = long.withColumn("season", F.get(F.array(*map(F.lit, years)), F.pmod(F.xxhash64("event_id", "trial"), F.lit(5)).cast("int")))
    assert got == {tuple(r) for r in long.groupBy("trial", "season", "cell_id").count().collect()}
