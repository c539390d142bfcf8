"""Small cases with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrack.functions import geo
from isotrack.operators import contrast, inference, joins, models, tracks
from isotrack.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distance_of_one_degree(spark):
    z = F.lit(0.0)
    assert one(spark, geo.great_circle_km(z, z, z, F.lit(1.0))) == pytest.approx(111.194926645, abs=1e-6)


def test_longitudes(spark):
    assert one(spark, geo.wrap_lon(F.lit(-10.0))) == 350
    assert one(spark, geo.lon_difference(F.lit(350.0), F.lit(10.0))) == 20


def test_boxes_take_the_first_match(spark):
    assert one(spark, geo.classify_boxes(F.lit(22.0), F.lit(120.0))) == "Taiwan"
    assert one(spark, geo.classify_boxes(F.lit(-5.0), F.lit(0.0))) == "Other"


def test_flags_of_short_text_are_false(spark):
    assert one(spark, geo.flag_at(F.lit("O"), 2, "OV")) is False


def test_geopotential_units():
    with pytest.raises(ValueError):
        geo.geopotential_height(F.lit(1.0), "furlong")


def test_bh_keeps_nulls(spark):
    rows = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", None), ("a", 0.03)], "f string, p double")
    q = {r["p"]: r["q"] for r in inference.bh_fdr(rows, "p", ["f"]).collect()}
    assert q[None] is None and q[0.01] == pytest.approx(0.03) and q[0.01] <= q[0.03] <= q[0.04] <= 1


def test_blocks_do_not_span_gaps(spark):
    years = spark.createDataFrame([(y,) for y in [*range(1966, 1971), *range(1980, 1985)]], "season int")
    blocks = {}
    for r in tracks.year_blocks(years, 3).collect():
        blocks.setdefault(r["block"], []).append(r["season"])
    assert sorted(map(sorted, blocks.values())) == [[1966, 1967, 1968], [1969, 1970], [1980, 1981, 1982], [1983, 1984]]


def test_exposure_terms(spark):
    rows = [(1, 0, 1.0, 10.0), (1, 1, 0.0, 20.0), (2, 0, 0.0, 12.0), (2, 1, 1.0, 22.0)]
    r = contrast.exposure_change(spark.createDataFrame(rows, "season int, cell_id int, w double, h double"), (1, 1), (2, 2)).first()
    assert (r["delta"], r["redistribution"], r["state_change"], r["covariation"]) == (12, 10, 2, 0)


def test_between_groups_only(spark):
    rows = [(1, "a", 0, 0.8), (1, "b", 1, 0.2), (2, "a", 0, 0.2), (2, "b", 1, 0.8)]
    out = contrast.between_within(spark.createDataFrame(rows, "season int, g string, cell_id int, share double"), "g", (1, 1), (2, 2)).collect()
    assert all(r["within"] == pytest.approx(0) and r["between"] == pytest.approx(r["change"]) for r in out)


def test_safe_join_refuses_duplicates(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        joins.safe_join(left, right, ["k"])


def test_separation_is_from_the_last_kept(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, i, base + dt.timedelta(hours=h)) for i, h in enumerate([0, 8, 13, 20, 26])]
    kept = tracks.min_separation(spark.createDataFrame(rows, "sid int, event_id long, iso_time timestamp_ntz")).collect()
    assert sorted(r["event_id"] for r in kept) == [0, 2, 4]


def test_theil_sen_of_a_line(spark):
    rows = [("a", y, 0.5 * y) for y in range(1980, 1990)]
    r = inference.theil_sen(spark.createDataFrame(rows, "k string, x int, y double"), ["k"], "x", "y").first()
    assert r["slope"] == pytest.approx(0.5) and r["mk_s"] == 45


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("SID,T,LAT,LON\n ,units,deg,deg\na,2020-01-01 00:00:00, ,-10\nb,2020-01-01 06:00:00,5,20\n")
    df = readers.read_points(spark, str(tmp_path / "p.csv"), {"sid": "SID", "iso_time": "T", "lat": "LAT", "lon": "LON"}, ["lat", "lon"], required=["lat"], units_row=True)
    assert [(r["sid"], r["lon"]) for r in df.collect()] == [("b", 20.0)]
    (tmp_path / "i.txt").write_text("junk\n2000 " + " ".join(str(i) for i in range(1, 13)) + "\n")
    assert readers.read_monthly_index(spark, str(tmp_path / "i.txt"), [6, 7, 8, 9, 10], "pdo").first()["pdo"] == 8.0
    with pytest.raises(ValueError):
        readers.require_columns(df, ["nope"])


def test_glm_recovers_coefficients(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(4000)
    rows = [(float(a), float(rng.random() < 1 / (1 + np.exp(0.5 - a))), float(rng.poisson(np.exp(0.2 + 0.3 * a)))) for a in x]
    df = spark.createDataFrame(rows, "x double, b double, c double")
    logit, log = models.glm(df, "b", ["x"]), models.glm(df, "c", ["x"], "poisson")
    assert logit["const"] == pytest.approx(-0.5, abs=0.15) and logit["x"] == pytest.approx(1, abs=0.15)
    assert log["const"] == pytest.approx(0.2, abs=0.1) and log["x"] == pytest.approx(0.3, abs=0.1)


def test_fuzzy_centers_find_two_heaps(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(5.0 * (i % 2), 0.2, 3)]) for i in range(200)]
    centers = models.fuzzy_centers(spark.createDataFrame(rows, "id int, v array<double>"), "v", np.array([[1.0] * 3, [4.0] * 3]))
    assert np.allclose(sorted(centers[:, 0]), [0, 5], atol=0.2)


def test_wavelet_peak(spark):
    rows = [("a", t, float(np.sin(2 * np.pi * t / 4))) for t in range(256)]
    power = models.wavelet_spectrum(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v", dj=0.125).collect()
    assert abs(max(power, key=lambda r: r["power"])["period"] - 4) <= 1


def test_hac_of_an_exact_line(spark):
    rows = [("a", t, float(t % 5), 2.0 + 3.0 * (t % 5)) for t in range(30)]
    out = {r["term"]: r for r in models.hac_regression(spark.createDataFrame(rows, "k string, t int, x double, y double"), ["k"], "t", "y", ["x"]).collect()}
    assert out["x"]["coef"] == pytest.approx(3) and out["x"]["se"] == pytest.approx(0, abs=1e-8)


def test_student_tail():
    from isotrack.operators.inference import student_p

    for t, df, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e6, 0.05), (0.0, 5, 1.0), (-3.169273, 10, 0.01)):
        assert abs(student_p(t, df) - p) < 1e-5


def test_robust_z_without_spread(spark):
    from isotrack.operators.inference import robust_z

    same = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 7.0)], "season int, y double")
    assert {r.season: r.z for r in robust_z(same, "y").collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: float("inf")}
    some = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "season int, y double")
    assert {r.season: r.z for r in robust_z(some, "y").collect()}[2] == 0


def test_shapley_closes_and_weighs_years_alike(spark):
    import random

    from isotrack.operators.contrast import shapley

    rng = random.Random(3)
    rows = [(sid, 1 + sid % 30, f"2024-01-01 {h:02}:00:00", h, rng.randint(0, 1), rng.randint(0, 7)) for sid in range(360) for h in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(rows, "sid int, season int, iso_time string, event_id int, start int, cell_id int")
    got = shapley(frame, (1, 15), (16, 30), "start", least=1).collect()
    assert all(abs(r.genesis + r.propagation - r.change) < 1e-12 for r in got)
    assert abs(sum(r.change for r in got)) < 1e-12 and len(got) == 8
    year = {(sid, s): b for sid, s, _, h, b, _ in rows if h == 0}
    field = {}
    for late in (False, True):
        seasons = [s for s in range(1, 31) if (s > 15) == late]
        for s in seasons:
            own = [sid for sid, y in year if y == s]
            for sid in own:
                cells = [c for i, _, _, _, _, c in rows if i == sid]
                for c in cells:
                    field[late, c] = field.get((late, c), 0) + 1 / (len(seasons) * len(own) * len(cells))
    assert all(abs(r.change - field.get((True, r.cell_id), 0) + field.get((False, r.cell_id), 0)) < 1e-12 for r in got)


def test_native_stage_and_missing_values(spark):
    from pyspark.sql import functions as F

    from isotrack.operators import relational as rel

    rows = [("USA", 34.0, None, None, True), ("USA", 34.0, " et ", None, False), ("USA", 33.0, "TS", None, False), ("TOKYO", None, None, 9, True), ("TOKYO", 99.0, None, None, False), ("CMA", 1.0, None, 6, True), ("CMA", 1.0, None, 9, False), ("X", 99.0, "TS", 5, False)]
    frame = spark.createDataFrame(rows, "agency string, wind double, status string, grade int, want boolean")
    got = frame.select(rel.native_stage(F.col("agency"), F.col("wind"), F.col("status"), F.col("grade")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_rasters_at_their_edges(spark):
    from isotrack.operators import relational as rel

    raster = spark.createDataFrame([(r, c, (r + c) % 2 == 0) for r in range(2) for c in range(3)], "row int, col int, land boolean")
    at = [(0, 100.0, 30.0), (1, 99.5, 30.5), (2, 115.0, 20.0), (3, 98.9, 29.0), (4, 115.1, 25.0)]
    frame = spark.createDataFrame(at, "id int, lon double, lat double")
    state = {r.id: r.land for r in rel.raster_state(frame, raster, 100.0, 30.0, 5.0).collect()}
    assert state == {0: True, 1: True, 2: None, 3: True, 4: None}
    kind = {r.id: r.state for r in rel.raster_class(frame, raster, 100.0, 30.0, 5.0, 2, 3).collect()}
    assert kind == {0: 1, 1: -1, 2: 0, 3: -1, 4: -1}


def test_entries_into_a_square(spark):
    from isotrack.operators.spatial import edge_crossings, first_entries

    square = [(0, 10.0, 10.0, 20.0, 10.0), (1, 20.0, 10.0, 20.0, 20.0), (2, 20.0, 20.0, 10.0, 20.0), (3, 10.0, 20.0, 10.0, 10.0)]
    edges = spark.createDataFrame(square, "edge_id int, x1 double, y1 double, x2 double, y2 double")
    segs = [(1, 1, 15.0, 5.0, 15.0, 15.0), (1, 2, 15.0, 15.0, 15.0, 25.0), (1, 3, 5.0, 5.0, 15.0, 15.0), (1, 4, 15.0, 5.0, 15.0, 25.0), (1, 5, 1.0, 1.0, 2.0, 2.0)]
    frame = spark.createDataFrame(segs, "sid int, event_id int, lat double, lon double, lat2 double, lon2 double")
    got = {r.event_id: (r.lat, r.lon) for r in first_entries(edge_crossings(frame, edges)).collect()}
    assert got == {1: (15.0, 10.0), 3: (10.0, 10.0), 4: (15.0, 10.0)}


def test_separation_starts_anew_after_gaps(spark):
    from isotrack.operators.tracks import min_separation

    at = [0, 5, 11, 12, 20, 24, 50, 55, 62, 63]
    rows = [(1, i, h) for i, h in enumerate(at)]
    frame = spark.createDataFrame(rows, "sid int, event_id int, h int").selectExpr("sid", "event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, h) AS iso_time")
    assert {at[r.event_id] for r in min_separation(frame).collect()} == {0, 12, 24, 50, 62}


def test_fuzzy_membership_of_null_vectors_is_null(spark):
    rows = [(1, [1.0, 1.0]), (2, None), (3, [None, 1.0])]
    found = inference.fuzzy_membership(spark.createDataFrame(rows, "id int, v array<double>"), "v", [[1.0, 1.0], [4.0, 4.0]]).collect()
    got = {r.id: r.membership for r in found}
    assert got[1][0] == pytest.approx(1.0) and got[2] == got[3] == [None, None]
