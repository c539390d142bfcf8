"""Exact crossings: boxes, islands, lakes, shared edges, the antimeridian, and the chain from candidates."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from isotrack.operators import coast, joins


def box(polygon, w, s, e, n):
    c = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    return [(polygon, *map(float, a), *map(float, b)) for a, b in zip(c, c[1:])]


def edges(spark, *boxes):
    return spark.createDataFrame([e for b in boxes for e in b], "polygon_id int, x1 double, y1 double, x2 double, y2 double")


def entries(spark, lands, lines):
    segs = spark.createDataFrame([(i, *map(float, (y1, x1, y2, x2))) for i, ((x1, y1), (x2, y2)) in enumerate(lines)], "id int, lat double, lon double, lat2 double, lon2 double")
    out = {i: [] for i in range(len(lines))}
    for r in coast.entry_fractions(segs, edges(spark, *lands), ["id"]).collect():
        out[r.id].append(round(r.f, 9))
    return [sorted(v) for v in out.values()]


def test_entries(spark):
    main = box(0, 100, 9, 102, 11)
    assert entries(spark, [main], [((98, 10), (101, 10)), ((101, 10), (99, 10)), ((100.5, 10), (101.5, 10)), ((90, 0), (91, 1)), ((98, 10), (104, 10))]) == [[round(2 / 3, 9)], [], [], [], [round(1 / 3, 9)]]
    island = box(1, 99.8, 9.8, 100.2, 10.2)
    assert entries(spark, [island], [((99, 10), (101, 10))]) == [[0.4]]
    lake = [(0, *e[1:]) for e in box(0, 100.5, 9.5, 101.5, 10.5)]
    assert entries(spark, [main, lake], [((98, 10), (104, 10)), ((101, 10), (101, 13)), ((101, 10), (101, 10.2))]) == [[round(2 / 6, 9), round(3.5 / 6, 9)], [round(0.5 / 3, 9)], []]
    # through a corner, along an edge (an edge is land), and only up to the coast
    assert entries(spark, [main], [((99, 8), (101, 10)), ((98, 9), (101, 9)), ((98, 10), (100, 10)), ((101, 8), (101, 9))]) == [[0.5], [round(2 / 3, 9)], [1.0], [1.0]]
    # two neighbours that share an edge are entered once
    assert entries(spark, [main, box(1, 102, 9, 104, 11)], [((99, 10), (103, 10))]) == [[0.25]]


def test_entries_across_the_antimeridian(spark):
    land = box(0, 359, 9, 361, 11)
    assert entries(spark, [land], [((358, 10), (0.5, 10)), ((2, 10), (0, 10)), ((359.5, 10), (0.5, 10))]) == [[0.4], [0.5], []]


def test_on_land(spark):
    places = spark.createDataFrame([(1, 101.0, 10.0), (2, 99.0, 10.0), (3, 100.0, 10.0), (4, 101.0, 9.0), (5, 101.0, 11.0), (6, 100.0, 9.0), (7, 103.0, 9.0)], "id int, px double, py double")
    got = {r.id: r.land for r in coast.on_land(places, coast.turned(edges(spark, box(0, 100, 9, 102, 11))), ["id"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_chain(spark):
    t = datetime(2000, 1, 1)
    h = lambda n: t + timedelta(hours=n)
    rows = [("USA", 1, k, h(6 * k), 10.0, 98.0 + 1.5 * k, w) for k, w in enumerate([30.0, 40.0, 50.0, None, 60.0])]
    rows += [("USA", 2, 10, h(0), 10.0, 98.0, 30.0), ("USA", 2, 11, h(6), 10.0, 101.0, None), ("USA", 3, 20, h(0), 30.0, 98.0, 1.0), ("USA", 3, 21, h(6), 30.0, 99.0, 1.0)]
    points = spark.createDataFrame(rows, "agency string, sid int, event_id int, iso_time timestamp_ntz, lat double, lon double, wind double")
    land = edges(spark, box(0, 100, 9, 102, 11))
    asked = [(1, "USA", 1, h(7)), (2, "USA", 1, h(9)), (3, "USA", 2, h(3)), (4, "USA", 3, h(3)), (5, "USA", 9, h(3)), (6, "USA", 3, h(30)), (7, "CMA", 1, h(7))]
    asked = spark.createDataFrame(asked, "probe_id int, agency string, sid int, time timestamp_ntz")
    events, unresolved = coast.refine_crossings(asked, points, land, F.lit("X"))
    got = {r.sid: r for r in events.collect()}
    assert set(got) == {1, 2} and events.count() == 2
    assert (got[1].time, round(got[1].lon, 9), round(got[1].wind, 9)) == (h(8), 100.0, round(40 + 10 / 3, 9))
    assert (got[2].time, round(got[2].lon, 9), got[2].wind) == (h(4), 100.0, None)
    reasons = {(r.agency, r.sid, r.time): r.reason for r in unresolved.collect()}
    assert reasons == {("USA", 3, h(3)): "no_exact_sea_to_land_intersection", ("USA", 9, h(3)): "sid_not_in_track_segments", ("USA", 3, h(30)): "candidate_not_bracketed", ("CMA", 1, h(7)): "sid_not_in_track_segments"}

    states = points.select("agency", "sid", "iso_time", (F.col("iso_time") != F.lit(h(12)).cast("timestamp_ntz")).alias("native"))
    authority = events.select("agency", "sid", "segment_start", "segment_end", F.lit("Y").alias("coast_exclusive"))
    out = {r.sid: r for r in coast.attach_states(events, states, authority).collect()}
    assert (out[1].pre_crossing, out[1].either_end, out[1].both_ends, out[1].coast, out[1].coast_screened) == (True, True, False, "Y", "X")
    with pytest.raises(ValueError):
        coast.attach_states(events, states.where("sid = 1"), authority)
    with pytest.raises(ValueError):
        coast.attach_states(events, states.union(states), authority)

    screened = asked.withColumn("lat", F.lit(10.5)).withColumn("lon", F.lit(100.0))
    apart = {r.probe_id: r for r in coast.compare_with_screen(screened, events).collect()}
    assert apart[1].matched and round(apart[1].hours_apart, 9) == 1 and round(apart[1].lat_apart, 9) == -0.5 and not apart[5].matched
    audit = coast.screen_audit(screened, unresolved, ["agency"]).collect()
    assert {(r.agency, r.candidate_n, r.unresolved_n, round(r.unresolved_fraction, 6)) for r in audit} == {("USA", 6, 3, 0.5), ("CMA", 1, 1, 1.0)}


def test_nearest_time_of_a_busy_entity(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("1 AS sid", "id", "timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, 0, id * 7 % 1000003) AS t")
    left, right = rows.where("id % 2 = 0").withColumnRenamed("t", "left_t"), rows.where("id % 2 = 1").select("sid", F.col("t").alias("right_t"), F.col("id").alias("tie"))
    import time

    began = time.time()
    got = joins.nearest_time_join(left, right, ["sid"], "id", "left_t", "right_t", "tie").agg(F.count("*").alias("n"), F.max("apart_us").alias("most")).first()
    assert got.n == n // 2 and got.most <= 20_000_000 and time.time() - began < 60
