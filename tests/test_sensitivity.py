"""Scenarios of decompositions and contrasts against loops over rows, composites, sinks and manifests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrack.operators import resampled, sensitivity
from isotrack.sources import readers, sinks

YEARS = list(range(1, 13))


def parts(pe, pl, qe, ql):
    me, ml = qe / pe, ql / pl
    return ((pl - pe) * (ml + me) / 2).sum(), ((pl + pe) / 2 * (ml - me)).sum()


def test_moments(spark):
    rng = random.Random(1)
    events, members, pi, mo = [], [], np.zeros((12, 3)), np.zeros((12, 3))
    for y in range(12):
        n = rng.randint(3, 9)
        for i in range(n):
            m, v = np.random.default_rng(100 * y + i).dirichlet([1, 1, 1]), rng.uniform(5, 40)
            events.append((YEARS[y], i, v))
            members += [(YEARS[y], i, g, float(m[g])) for g in range(3)]
            pi[y] += m / n
            mo[y] += m * v / n
    extra = [(3, 77, 12.0), (4, 0 + 88, None)]  # without membership, without value
    e = spark.createDataFrame(events + extra, "season int, sid int, lat double")
    m = spark.createDataFrame(members + [(4, 88, 0, 1.0)], "season int, sid int, family int, m double")
    rows = sensitivity.group_moments(e, m, "family", "lat")
    weights = resampled.year_weights(spark.createDataFrame([(y, "e" if y <= 6 else "l") for y in YEARS], "season int, period string"), 3, 25, 5, circular=False)
    groups = sensitivity.moment_groups(rows, weights, "family")
    got = {r.rep: r for r in sensitivity.moment_change(groups).collect()}
    drawn = {k: [] for k in ("change", "between", "within")}
    for r in weights.collect():
        a, b = np.array(r.early), np.array(r.late)
        between, within = parts(a @ pi, b @ pi, a @ mo, b @ mo)
        g = got[r.rep]
        assert np.allclose([g.mean_early, g.mean_late, g.between, g.within], [(a @ mo).sum(), (b @ mo).sum(), between, within])
        assert g.closure_abs < 1e-9
        if r.rep:
            for k in drawn:
                drawn[k].append(g[k])
    for r in sensitivity.moment_bootstrap(groups).collect():
        assert np.allclose([r.low, r.median, r.high], np.quantile(drawn[r.quantity], [0.025, 0.5, 0.975])) and r.n == 25
    lone = m.where("family < 2 or season > 6").withColumn("m", F.lit(0.5))
    out = sensitivity.moment_change(sensitivity.moment_groups(sensitivity.group_moments(e, lone, "family", "lat"), weights, "family")).where("rep = 0").first()
    assert out.between is None and out.within is None and out.change is not None


def test_period_weights(spark):
    years = spark.createDataFrame([(y,) for y in YEARS], "season int")
    r = sensitivity.period_weights(years, [("a", 2, 5, 12)]).first()
    assert (r.n_early, r.n_late) == (3, 8) and np.allclose(r.early, [0] + [1 / 3] * 3 + [0] * 8) and np.allclose(sum(r.late), 1)
    for bad in (("b", 5, 5, 12), ("b", 4, 5, 12), ("b", 2, 12, 12), ("b", 0, 5, 12), ("b", 2, 5, 13)):
        with pytest.raises(ValueError):
            sensitivity.period_weights(years, [bad])


def test_period_sensitivity(spark):
    rng = np.random.default_rng(4)
    joint = rng.random((12, 2, 5))
    joint /= joint.sum((1, 2), keepdims=True)
    df = spark.createDataFrame([(YEARS[y], g, c, float(joint[y, g, c])) for y in range(12) for g in range(2) for c in range(5)], "season int, family int, cell_id int, share double")
    for r in sensitivity.period_sensitivity(df, sensitivity.period_weights(df, [("a", 1, 7, 12), ("b", 3, 6, 11)]), "family").collect():
        e, w = joint[r.start - 1 : r.cutpoint - 1].mean(0), joint[r.cutpoint - 1 : r.end].mean(0)
        pe, pl = e.sum(1), w.sum(1)
        fe, fl = e / pe[:, None], w / pl[:, None]
        d = (w - e).sum(0)
        between = ((pl - pe)[:, None] * (fl + fe) / 2).sum(0)
        assert np.allclose([r.between_share, r.within_share, r.total_variation], [between @ d / (d @ d), (d - between) @ d / (d @ d), abs(d).sum() / 2])
        assert r.closure_max_abs < 1e-12


def test_domains(spark):
    rng = random.Random(6)
    pts = [(rng.choice(YEARS), s, rng.uniform(-5, 45), rng.uniform(95, 185)) for s in range(40) for _ in range(8)] + [(1, 99, -3.0, 120.0)]
    p = spark.createDataFrame(pts, "season int, sid int, lat double, lon double")
    domains = [("in", (100.0, 180.0, 0.0, 40.0), 10.0, False), ("fixed", (100.0, 180.0, 0.0, 40.0), 10.0, True)]
    shares, entities = sensitivity.inside_domains(p, domains)
    own = {}
    for y, s, lat, lon in pts:
        own.setdefault((y, s), []).append(0 <= lat <= 40 and 100 <= lon <= 180)
    for r in shares.groupBy("mode", "season", "sid").agg(F.sum("share").alias("t")).collect():
        inside = own[(r.season, r.sid)]
        assert r.t == pytest.approx(1.0 if r["mode"] == "in" else sum(inside) / len(inside))
    valid = {(r["mode"], r.season, r.sid) for r in entities.where("valid").collect()}
    assert valid == {("fixed", *k) for k in own} | {("in", *k) for k, v in own.items() if any(v)} and ("in", 1, 99) not in valid
    members = spark.createDataFrame([(*k, g, 0.25 if g else 0.75) for k in own for g in (0, 1)], "season int, sid int, family int, m double")
    got = {r["mode"]: r for r in sensitivity.domain_sensitivity(p, members, domains, "family", (1, 6), (7, 12)).collect()}
    assert got["in"].mass_early == pytest.approx(1.0) and got["in"].coverage == pytest.approx(sum(map(sum, own.values())) / len(pts))
    want = np.mean([np.mean([sum(v) / len(v) for k, v in own.items() if k[0] == y]) for y in range(1, 7)])
    assert got["fixed"].mass_early == pytest.approx(want) and got["fixed"].valid_fraction == 1.0
    labels = p.groupBy("season", "sid").agg((F.count("*") % 2).cast("string").alias("label")).withColumn("period", F.when(F.col("season") <= 6, "e").otherwise("l"))
    null = {r["mode"]: r for r in sensitivity.domain_null(p, labels, domains, 19, 1).collect()}
    assert set(null) == {"in", "fixed"} and all(0 < r.p_two_sided <= 1 for r in null.values())


def test_shuffled_blocks_respect_gaps():
    w = sensitivity.shuffled([1, 2, 3, 7], [8, 9, 10], 2, 50, 3)
    assert w.shape == (51, 7) and np.allclose(w.sum(1), 0)
    assert np.allclose(w[0], [-0.25] * 4 + [1 / 3] * 3)
    assert all((r < 0).sum() == 4 for r in w) and len({tuple(r) for r in w}) > 5
    pairs = [(0, 1), (3, 4), (5, 6)]  # years 1 2, 7 8 and 9 10; year 3 is a block of its own
    assert sum((r[a] > 0) != (r[b] > 0) for r in w for a, b in pairs) <= 51


def test_robustness_matrix(spark):
    rng = np.random.default_rng(8)
    v = rng.random((2, 12, 6)) * (rng.random((2, 12, 6)) > 0.2)
    v[1, 6:, :2] += 4.0
    v /= v.sum(2, keepdims=True)
    df = spark.createDataFrame([(f"f{f}", "point", YEARS[y], c, float(v[f, y, c])) for f in range(2) for y in range(12) for c in range(6) if v[f, y, c]], "field string, weighting string, season int, cell_id int, share double")
    entry = lambda a, f, **k: {"analysis": a, "field": f, "weighting": "point", "block": 2, "early": (1, 6), "late": (7, 12), "cells": 10, **k}
    design = [entry("main", "f0"), entry("main", "f1"), entry("drop", "f1", without=[3, 4], against="main"), entry("blocks", "f0", block=3, against="main")]
    got = {r.config: r for r in sensitivity.robustness_matrix(df, design, 99, 11).collect()}
    change = {}
    for i, c in enumerate(design):
        early, late = ([y for y in YEARS if y not in (c.get("without") or []) and c[p][0] <= y <= c[p][1]] for p in ("early", "late"))
        a = v[int(c["field"][1])][[y - 1 for y in early + late]]
        tv = np.abs(sensitivity.shuffled(early, late, c["block"], 99, 11) @ a).sum(1) / 2
        change[i] = np.append(a[len(early) :].mean(0) - a[: len(early)].mean(0), [0] * 4)
        assert (got[i].n_early, got[i].n_late) == (len(early), len(late)) and got[i].tv == pytest.approx(tv[0])
        assert got[i].p_value == pytest.approx(((tv[1:].round(9) >= tv[0].round(9)).sum() + 1) / 100)
    assert got[0].corr is None and got[3].corr == pytest.approx(1.0) and got[2].corr == pytest.approx(np.corrcoef(change[1], change[2])[0, 1])
    with pytest.raises(ValueError):
        sensitivity.robustness_matrix(df, [entry("none", "f0", without=range(1, 7))], 9, 1)


def test_composites_count_a_time_once(spark):
    members = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("a", 2, 7), ("b", 2, 8), (None, 3, 9)], "family string, season int, sid int")
    field = spark.createDataFrame([(1, 0, 2.0), (2, 0, 6.0), (3, 0, 9.0), (2, 1, None)], "season int, cell_id int, v double")
    got = {(r.family, r.cell_id): (r.n_times, r.v) for r in sensitivity.group_composites(members, field, "family", ["cell_id"], ["v"]).collect()}
    assert got == {("a", 0): (2, 4.0), ("b", 0): (1, 6.0), ("a", 1): (1, None), ("b", 1): (1, None)}


def test_csv_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b\"c", 2.5, [1, 2]), (2, "", None, None), (3, None, -1.0, [])], "id int, name string, lon double, more array<int>")
    sinks.write_csv(df, str(tmp_path / "t"), gzip=True)
    back = {r.id: r for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "t")).collect() for r in [r.asDict()] for r in [type("R", (), r)]}
    assert {k: r.lon for k, r in back.items()} == {"1": "2.5", "2": None, "3": "-1.0"} and back["1"].more == "[1,2]"
    assert list((tmp_path / "t").glob("*.csv.gz"))
    timed = df.select("id", "lon", F.lit("2001-02-03 04:05:06").cast("timestamp_ntz").alias("iso_time"))
    sinks.write_csv(timed, str(tmp_path / "u"), units={"lon": "degrees_east", "iso_time": "UTC"})
    got = readers.read_points(spark, str(tmp_path / "u"), {"id": "id", "lon": "lon", "iso_time": "iso_time"}, ["id", "lon"], units_row=True).collect()
    assert sorted((r.id, r.lon) for r in got if r.lon is not None) == [(1.0, 2.5), (3.0, 359.0)] and len(got) == 3
    sinks.write_table(df, str(tmp_path / "p"), ["id"], 1)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 and (tmp_path / "p" / "id=2").exists()
    (tmp_path / "m").mkdir()
    for n, text in (("a.txt", "x"), ("b.txt", "y"), ("c.txt", "z")):
        (tmp_path / "m" / n).write_text(text)
    frozen = spark.createDataFrame(sinks.manifest(spark, str(tmp_path / "m")).collect())
    (tmp_path / "m" / "b.txt").write_text("other")
    (tmp_path / "m" / "c.txt").unlink()
    (tmp_path / "m" / "d.txt").write_text("new")
    got = {r.name: r.state for r in sinks.check_manifest(sinks.manifest(spark, str(tmp_path / "m")), frozen).collect()}
    assert got == {"a.txt": "same", "b.txt": "changed", "c.txt": "missing", "d.txt": "new"}


def test_members_of_an_ensemble_share_paths(spark, monkeypatch):
    from isotrack.plans import simulation

    class Enough(Exception):
        pass

    seen = []

    def advect(seeds, *_, **__):
        seen.append(seeds)
        raise Enough

    monkeypatch.setattr(simulation.advection, "advect", advect)
    with pytest.raises(Enough):
        simulation.year_ensemble(spark, "/root/testdata/sf0.001")
    seeds = seen[0]
    days = seeds.select("sid", "season").distinct().count()
    assert seeds.count() == seeds.select("sid", "season", "flow").distinct().count() < 30 * days
    assert seeds.agg(F.sum(F.size("of"))).first()[0] == 2 * simulation.MEMBERS * days
