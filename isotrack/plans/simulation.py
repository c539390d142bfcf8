"""Named queries of points carried by flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import advection, density
from ..sources.adapters import points
from .registry import PTS, cell, query

BOX = (100.0, 180.0, 0.0, 40.0)
GRID = {"south": 5.0, "west": 105.0, "width": 10.0, "box": BOX, "alpha": 0.8, "beta_u": -1.0, "beta_v": 0.5}
MEMBERS = 20


def nodes(keys: str) -> str:
    """Mean flow on nodes of ten degrees, and the cells between them."""
    on = " AND ".join(f"a.{k} = {{0}}.{k}" for k in keys.split(", "))
    return f"""nod AS (SELECT {keys}, floor(lat / 10)::INT AS row, floor((lon - 100) / 10)::INT AS col, (avg(wind) - 50) / 10 AS u, (avg(lon) - 140) / 10 AS v FROM src WHERE lat < 40 AND lon < 180 GROUP BY ALL),
cel AS (SELECT {", ".join(f"a.{k}" for k in keys.split(", "))}, a.row, a.col, a.u AS u0, b.u AS u1, c.u AS u2, e.u AS u3, a.v AS v0, b.v AS v1, c.v AS v2, e.v AS v3 FROM nod a JOIN nod b ON {on.format("b")} AND b.row = a.row AND b.col = a.col + 1
  JOIN nod c ON {on.format("c")} AND c.row = a.row + 1 AND c.col = a.col JOIN nod e ON {on.format("e")} AND e.row = a.row + 1 AND e.col = a.col + 1)"""


def walk(ids: str, keys: str) -> str:
    """Every step of the seeds ``sed`` (ids, keys, lat, lon, steps): wlk (ids, k, lat, lon)."""
    mix = lambda p: f"({p}0 * (1 - wy) * (1 - wx) + {p}1 * (1 - wy) * wx + {p}2 * wy * (1 - wx) + {p}3 * wy * wx)"
    inside = "lat BETWEEN 0 AND 40 AND lon BETWEEN 100 AND 180"
    on = " AND ".join(f"w.{k} = c.{k}" for k in keys.split(", "))
    mine = ", ".join(f"w.{k}" for k in f"{ids}, {keys}".split(", "))
    return f"""wlk AS (SELECT {ids}, {keys}, 0 AS k, lat, lon, steps AS left_over FROM sed WHERE steps > 0 AND {inside} UNION ALL
SELECT * FROM (SELECT {ids}, {keys}, k + 1 AS k, lat + degrees((0.8::DOUBLE * {mix("v")} + 0.5) * 21600 / 6371000) AS lat, lon + degrees((0.8::DOUBLE * {mix("u")} - 1) * 21600 / (6371000 * cos(radians(lat)))) AS lon, left_over - 1 AS left_over FROM
  (SELECT {mine}, w.k, w.lat, w.lon, w.left_over, c.u0, c.u1, c.u2, c.u3, c.v0, c.v1, c.v2, c.v3, (w.lat - 5) / 10 - c.row AS wy, (w.lon - 105) / 10 - c.col AS wx FROM wlk w JOIN cel c ON {on} AND c.row = floor((w.lat - 5) / 10)::INT AND c.col = floor((w.lon - 105) / 10)::INT WHERE w.left_over > 1)) WHERE {inside})"""


def flow(p, *keys):
    p = p.where("lat < 40 AND lon < 180").groupBy(*keys, F.floor(F.col("lat") / 10).cast("int").alias("row"), F.floor((F.col("lon") - 100) / 10).cast("int").alias("col"))
    return p.agg(((F.avg("wind") - 50) / 10).alias("u"), ((F.avg("lon") - 140) / 10).alias("v"))


def starts(p, *ids):
    first = F.struct("iso_time", "event_id")
    return p.groupBy(*ids).agg(*[F.min_by(c, first).alias(c) for c in ("agency", "lat", "lon")], F.count("*").cast("int").alias("steps"))


@query("advection", f"WITH RECURSIVE {PTS}, src AS (SELECT * FROM pts), {nodes('agency')}, sed AS (SELECT sid, arg_min(agency, (iso_time, event_id)) AS agency, arg_min(lat, (iso_time, event_id)) AS lat, arg_min(lon, (iso_time, event_id)) AS lon, count(*) AS steps FROM pts GROUP BY sid), {walk('sid', 'agency')} SELECT sid, k, round(lat, 5) AS lat, round(lon, 5) AS lon FROM wlk")
def advection_paths(spark, d):
    p = points(spark, d)
    out = advection.advect(starts(p, "sid"), flow(p, "agency"), ["sid"], ["agency"], **GRID)
    return out.select("sid", "k", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


def relative(p, *by):
    """Mean over its years of a group's yearly shares: (by, cell_id, share)."""
    cells = density.with_cell(p).groupBy(*by, "season", "cell_id").agg(F.count("*").alias("n"))
    shares = cells.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "season")))
    years = cells.groupBy(*by).agg(F.countDistinct("season").alias("years"))
    return shares.join(F.broadcast(years), [*by]).groupBy(*by, "cell_id").agg((F.sum("s") / F.first("years")).alias("share"))  # a row a group


def relative_sql(source: str, by: str) -> str:
    return f"""cc AS (SELECT {by}, season, {cell()} AS cell_id, count(*)::DOUBLE AS n FROM {source} WHERE lat BETWEEN 0 AND 40 AND lon BETWEEN 100 AND 180 GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY {by}, season) AS s FROM cc),
yy AS (SELECT {by}, count(DISTINCT season) AS years FROM cc GROUP BY ALL), rel AS (SELECT {by}, cell_id, sum(s) / any_value(years) AS share FROM sh JOIN yy USING ({by}) GROUP BY ALL)"""


DAYS = "day AS (SELECT sid, season, arg_min(agency, (iso_time, event_id)) AS agency, arg_min(lat, (iso_time, event_id)) AS lat, arg_min(lon, (iso_time, event_id)) AS lon, count(*) AS steps FROM pts GROUP BY ALL)"
REMAP = """rnk AS (SELECT *, CASE WHEN season <= 15 THEN 1 ELSE 2 END AS half, row_number() OVER (PARTITION BY season <= 15 ORDER BY steps, sid, season) AS r, count(*) OVER (PARTITION BY season <= 15) AS n FROM day),
pos AS (SELECT t.*, (t.r - 0.5) / t.n * (SELECT count(*) - 1 FROM rnk d WHERE d.half <> t.half) AS pos FROM rnk t),
rem AS (SELECT p.sid, p.season, p.agency, p.lat, p.lon, p.half, greatest(1, round_even(a.steps + (p.pos - floor(p.pos)) * (coalesce(b.steps, a.steps) - a.steps), 0))::BIGINT AS steps FROM pos p JOIN rnk a ON a.half <> p.half AND a.r = floor(p.pos) + 1 LEFT JOIN rnk b ON b.half <> p.half AND b.r = floor(p.pos) + 2)"""


@query("scenario_shares", f"""WITH RECURSIVE {PTS}, {DAYS}, {REMAP}, src AS (SELECT *, CASE WHEN season <= 15 THEN 1 ELSE 2 END AS flow FROM pts), {nodes("agency, flow")},
sed AS (SELECT 'BASE_P1' AS scenario, sid, season, agency, 1 AS flow, lat, lon, steps FROM rnk WHERE half = 1 UNION ALL SELECT 'BASE_P2', sid, season, agency, 2, lat, lon, steps FROM rnk WHERE half = 2 UNION ALL SELECT 'STEER', sid, season, agency, 2, lat, lon, steps FROM rnk WHERE half = 1
  UNION ALL SELECT 'LOC', sid, season, agency, 1, lat, lon, steps FROM rem WHERE half = 2 UNION ALL SELECT 'LIFE', sid, season, agency, 1, lat, lon, steps FROM rem WHERE half = 1), {walk("scenario, sid, season", "agency, flow")}, {relative_sql("wlk", "scenario")},
dif AS (SELECT s.scenario, c.cell_id, coalesce(r.share, 0) - coalesce(b.share, 0) AS d FROM (SELECT DISTINCT scenario FROM rel WHERE scenario <> 'BASE_P1') s CROSS JOIN (SELECT DISTINCT cell_id FROM rel) c LEFT JOIN rel r ON r.scenario = s.scenario AND r.cell_id = c.cell_id LEFT JOIN rel b ON b.scenario = 'BASE_P1' AND b.cell_id = c.cell_id),
tv AS (SELECT scenario, sum(abs(d)) / 2 AS tv FROM dif GROUP BY scenario) SELECT scenario, round(tv, 6) AS tv, round(CASE WHEN scenario <> 'BASE_P2' THEN tv / sum(tv) FILTER (scenario <> 'BASE_P2') OVER () END, 6) AS share FROM tv""")
def scenario_shares(spark, d):
    """What the flow, the starting places and the lifetimes of the later days do to where the earlier days' points go."""
    p = points(spark, d)
    days = starts(p, "sid", "season").withColumn("half", F.when(F.col("season") <= 15, 1).otherwise(2))
    one, two, ids = days.where("half = 1"), days.where("half = 2"), ["sid", "season"]
    cases = {"BASE_P1": (one, 1), "BASE_P2": (two, 2), "STEER": (one, 2), "LOC": (advection.remapped_steps(two, one, ids), 1), "LIFE": (advection.remapped_steps(one, two, ids), 1)}
    seeds = None
    for name, (rows, number) in cases.items():
        rows = rows.select(F.lit(name).alias("scenario"), *ids, "agency", F.lit(number).alias("flow"), "lat", "lon", "steps")
        seeds = rows if seeds is None else seeds.unionAll(rows)
    field = flow(p.withColumn("flow", F.when(F.col("season") <= 15, 1).otherwise(2)), "agency", "flow")
    path = advection.advect(seeds, field, ["scenario", *ids], ["agency", "flow"], **GRID)
    out = advection.scenario_shares(relative(path, "scenario"), "BASE_P1", ["STEER", "LOC", "LIFE"])
    return out.select("scenario", F.round("tv", 6).alias("tv"), F.round("share", 6).alias("share"))


def drawn(days):
    """A row for each day and year drawn for it, ``flow``, with ``of``: the cases (tag, member) that drew it, whose path is one and the same.

    days: with ``cases``, an array of (tag, member, years).
    """

    def draw(c):
        n = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(9), c["tag"], c["member"], "sid", "season")), 1, 8), 16, 10).cast("long")
        return F.struct(c["tag"].alias("tag"), c["member"].alias("member"), F.get(c["years"], (n % F.size(c["years"])).cast("int")).alias("flow"))

    days = days.withColumn("cases", F.transform("cases", draw))
    days = days.withColumn("flow", F.explode(F.array_distinct(F.transform("cases", lambda c: c["flow"]))))
    mine = F.filter("cases", lambda c: c["flow"].eqNullSafe(F.col("flow")))
    return days.withColumn("of", F.transform(mine, lambda c: F.struct(c["tag"].alias("tag"), c["member"].alias("member")))).drop("cases")


@query("year_ensemble", f"""WITH RECURSIVE {PTS}, {DAYS}, src AS (SELECT *, season AS flow FROM pts), {nodes("flow")}, ys AS (SELECT season <= 15 AS early, list_sort(list(DISTINCT season)) AS years FROM pts GROUP BY 1),
sed AS (SELECT CASE WHEN early THEN 'A' ELSE 'B' END AS tag, m AS member, sid, season, years[('0x' || substr(md5('9_' || (CASE WHEN early THEN 'A' ELSE 'B' END) || '_' || m || '_' || sid || '_' || season), 1, 8))::BIGINT % len(years) + 1] AS flow, lat, lon, steps FROM day, ys, (SELECT unnest(range({MEMBERS})) AS m) WHERE season <= 15),
{walk("tag, member, sid, season", "flow")}, {relative_sql("wlk", "tag, member")}, n AS (SELECT tag, count(DISTINCT member)::DOUBLE AS n FROM rel GROUP BY tag)
SELECT tag, cell_id, round(sum(share) / any_value(n), 7) AS mean, round(sqrt(greatest(0, sum(share * share) / any_value(n) - pow(sum(share) / any_value(n), 2))), 7) AS sd FROM rel JOIN n USING (tag) GROUP BY ALL""")
def year_ensemble(spark, d):
    """Paths of the earlier days' starts in the flows of years drawn from either half, twenty times each: mean and spread of where they go."""
    p = points(spark, d)
    years = p.select(F.when(F.col("season") <= 15, "A").otherwise("B").alias("tag"), "season").distinct().groupBy("tag").agg(F.sort_array(F.collect_list("season")).alias("years"))
    cases = years.crossJoin(spark.range(MEMBERS).select(F.col("id").cast("int").alias("member"))).agg(F.collect_list(F.struct("tag", "member", "years")).alias("cases"))
    seeds = drawn(starts(p.where("season <= 15"), "sid", "season").crossJoin(F.broadcast(cases)))
    field = flow(p.withColumn("flow", F.col("season")), "flow")
    path = advection.advect(seeds, field, ["sid", "season", "of"], ["flow"], **GRID)
    path = path.select("season", "lat", "lon", F.inline("of"))
    out = advection.ensemble_noise(relative(path, "tag", "member"), "tag", "member")
    return out.select("tag", "cell_id", F.round("mean", 7).alias("mean"), F.round("sd", 7).alias("sd"))
