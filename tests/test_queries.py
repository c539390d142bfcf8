"""Every query with SQL gives the rows of that SQL; results are compared as sorted rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from isotrack.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def tidy(rows):
    return sorted((tuple(float(f"{v:.7g}") + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = tidy(tuple(r[c] for c in cols) for r in df.collect())
    cur = db.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == tidy(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables_are_read(spark):
    from isotrack.plans.registry import field, points

    seasons = {r.season for r in points(spark, DATA).select("season").distinct().collect()}
    assert len(seasons) > 27
    assert {r.season for r in field(spark, DATA).select("season").distinct().collect()} == seasons
    assert {r.season for r in QUERIES["year_blocks"](spark, DATA).collect()} == seasons
    assert QUERIES["field_weighted_mean"](spark, DATA).count() == len(seasons)
    pairs = QUERIES["nearest_cell"](spark, DATA).collect()
    assert {r.event_id % 5 for r in pairs} == {r.cell_id % 5 for r in pairs} == set(range(5))
    assert all(r.event_id != r.cell_id for r in pairs)


def test_nearest_cell_without_itself(spark):
    from isotrack.operators import joins

    p = spark.createDataFrame([(1, 10.0, 120.0), (2, 10.1, 120.0), (3, 30.0, 150.0)], "event_id long, lat double, lon double")
    cells = p.toDF("cell_id", "cell_lat", "cell_lon")
    assert {(r.event_id, r.cell_id) for r in joins.nearest_cell_join(p, cells, "event_id", 75.0, 1.0, itself=False).collect()} == {(1, 2), (2, 1)}
    assert {(r.event_id, r.cell_id) for r in joins.nearest_cell_join(p, cells, "event_id", 75.0, 1.0).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_nearest_cell_in_crowded_places(spark):
    """Copies of a place and crowds far apart: matches are those of all pairs, without a pair for each two of a crowd."""
    import math
    import random

    from isotrack.operators import joins

    rng = random.Random(4)
    places = [(10 + rng.random() / 50, 359.99 + rng.random() / 50) for _ in range(300)] + [(10.3, 120.1)] * 300 + [(rng.uniform(-40, 40), rng.uniform(118, 124)) for _ in range(300)] + [(10.0, 0.4)]
    p = spark.createDataFrame([(i, lat, lon % 360) for i, (lat, lon) in enumerate(places)], "event_id long, lat double, lon double")
    rows = [tuple(r) for r in p.collect()]

    def km(a, b):
        x, y, u, v = map(math.radians, (a[1], b[1], a[2], b[2]))
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin((v - u) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    cells = p.toDF("cell_id", "cell_lat", "cell_lon")
    found = joins.nearest_cell_join(p, cells, "event_id", 75.0, 1.0, itself=False).collect()
    want = {}
    for a in rows:
        near = min((round(km(a, b), 7), b[0]) for b in rows if b[0] != a[0])
        if near[0] <= 75:
            want[a[0]] = near
    assert {r.event_id: (round(r.match_km, 7), r.cell_id) for r in found} == want and len(found) == len(want)
    assert all((r.cell_lat, r.cell_lon) == rows[r.cell_id][1:] for r in found)
