"""Points carried by gridded flows, and what changes when only the flow, the start or the lifetime does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from ..functions.scratch import cut

STEP_S = 6 * 3600.0
CHUNK = 6  # steps between two cuts of the lineage
POINT = "array<struct<k:int,lat:double,lon:double>>"


def grid_cells(field: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __row, __col, __corners) of every cell of a grid whose four nodes are known; field: (keys, row, col, u, v)."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    nodes = field.where("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v)").withColumn("__c", corner)
    nodes = nodes.select(*keys, (F.col("row") - F.col("__c.a")).alias("__row"), (F.col("col") - F.col("__c.b")).alias("__col"), (F.col("__c.a") * 2 + F.col("__c.b")).alias("__at"), "u", "v")
    cells = nodes.groupBy(*keys, "__row", "__col").agg(F.map_from_entries(F.collect_list(F.struct("__at", F.struct("u", "v")))).alias("__m"))
    return cells.where(F.size("__m") == 4).select(*keys, "__row", "__col", F.transform(F.array(*map(F.lit, range(4))), lambda i: F.element_at("__m", i)).alias("__corners"))


def blend(part: str, wy: Column, wx: Column) -> Column:
    """Bilinear mean of the corners' ``part``."""
    c = [F.get("__corners", F.lit(i))[part] for i in range(4)]
    return c[0] * (1 - wy) * (1 - wx) + c[1] * (1 - wy) * wx + c[2] * wy * (1 - wx) + c[3] * wy * wx


def advect(seeds: DataFrame, field: DataFrame, ids: list[str], keys: list[str], south: float, west: float, width: float, box: tuple, alpha: float = 1.0, beta_u: float = 0.0, beta_v: float = 0.0) -> DataFrame:
    """(ids, k, lat, lon): the places of every seed at its steps of six hours, from its start on.

    seeds: (ids, keys, lat, lon, steps), ids unique; field: (keys, row, col, u, v) in metres a second on nodes
    ``width`` degrees apart, node (0, 0) at (south, west).  A seed leaves when its steps are used up, when it is
    outside ``box`` (west, east, south, north; that place is not listed any more), or where the field is unknown
    (that place is the last).  Motion is alpha times the field plus beta.

    Each step is one join of the seeds that are left with the cells they are in; seeds and field may both be of any
    size.  Seeds that have left drop out at every cut of the lineage, and the loop ends when none is left.
    """
    cells = cut(grid_cells(field, keys))
    state = seeds.select(*ids, *keys, "lat", "lon", F.col("steps").cast("int").alias("__left"), F.array().cast(POINT).alias("__path"))
    w, e, s, n = box
    done, k = [], 0
    while True:
        for _ in range(CHUNK):
            go = (F.col("__left") > 0) & F.col("lat").between(s, n) & F.col("lon").between(w, e)
            here = F.array(F.struct(F.lit(k).alias("k"), "lat", "lon"))
            state = state.withColumn("__go", F.coalesce(go, F.lit(False))).withColumn("__path", F.when(F.col("__go"), F.concat("__path", here)).otherwise(F.col("__path")))
            fy, fx = (F.col("lat") - south) / width, (F.col("lon") - west) / width
            state = state.withColumns({"__row": F.when(F.col("__go"), F.floor(fy).cast("int")), "__col": F.when(F.col("__go"), F.floor(fx).cast("int"))})
            state = state.join(cells, [*keys, "__row", "__col"], "left")
            u, v = (blend(c, fy - F.col("__row"), fx - F.col("__col")) for c in "uv")
            east = (alpha * u + beta_u) * STEP_S / (EARTH_KM * 1000 * F.cos(F.radians("lat")))
            north = (alpha * v + beta_v) * STEP_S / (EARTH_KM * 1000)
            state = state.select(
                *ids, *keys, (F.col("lat") + F.degrees(north)).alias("lat"), (F.col("lon") + F.degrees(east)).alias("lon"),
                F.when(F.col("__corners").isNotNull(), F.col("__left") - 1).otherwise(0).alias("__left"), "__path",
            )
            k += 1
        state = cut(state)
        done.append(state.select(*ids, F.inline("__path")))
        state = state.where("__left > 0").withColumn("__path", F.array().cast(POINT))
        if state.isEmpty():
            return reduce(DataFrame.unionAll, done)


def remapped_steps(target: DataFrame, donor: DataFrame, ids: list[str], value: str = "steps") -> DataFrame:
    """``target`` with each value replaced by the donor's quantile at its mid-rank, ties by ids; rounded, 1 at least.

    Ranks come from counts of equal values, which are few (numbers of steps), and places among equals; no window
    holds a whole table.
    """
    equal = target.groupBy(value).agg(F.count("*").alias("__c"))
    total = Window.partitionBy()
    below = equal.select(value, (F.sum("__c").over(Window.orderBy(value)) - F.col("__c")).alias("__below"), F.sum("__c").over(total).alias("__n"))
    rank = F.col("__below") + F.row_number().over(Window.partitionBy(value).orderBy(*ids))
    held = donor.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    held = held.select("__v", (F.sum("__c").over(Window.orderBy("__v")) - F.col("__c")).alias("__from"), F.sum("__c").over(Window.orderBy("__v")).alias("__to"), F.sum("__c").over(total).alias("__m"))
    ladder = held.agg(F.array_sort(F.collect_list(F.struct("__to", "__v"))).alias("__ladder"), F.first("__m").alias("__m"))  # one entry a number of steps
    out = target.join(below, value).withColumn("__pos", (rank - 0.5) / F.col("__n")).crossJoin(F.broadcast(ladder)).withColumn("__pos", F.col("__pos") * (F.col("__m") - 1))
    at = lambda i: F.get(F.filter("__ladder", lambda x: x["__to"] > i), F.lit(0))["__v"]
    low, high = at(F.floor("__pos")), at(F.least(F.floor("__pos") + 1, F.col("__m") - 1))
    new = low + (F.col("__pos") - F.floor("__pos")) * (high - low)
    return out.withColumn(value, F.greatest(F.lit(1), F.rint(new).cast("int"))).select(*target.columns)


def scenario_shares(change: DataFrame, base: str, parts: list[str]) -> DataFrame:
    """(scenario, tv, share) of mean fields (scenario, cell_id, share): half the absolute change from ``base``, and its part in the sum over ``parts``."""
    first = change.where(F.col("scenario") == base).select("cell_id", F.col("share").alias("b"))
    others = change.select("scenario").distinct().where(F.col("scenario") != base)
    cells = change.select("cell_id").distinct()
    rows = others.crossJoin(cells).join(change, ["scenario", "cell_id"], "left").join(first, "cell_id", "left").na.fill(0.0, ["share", "b"])  # scenarios are few
    tv = rows.groupBy("scenario").agg((F.sum(F.abs(F.col("share") - F.col("b"))) / 2).alias("tv"))
    part = F.col("scenario").isin(parts)
    return tv.withColumn("share", F.when(part, F.try_divide("tv", F.sum(F.when(part, F.col("tv"))).over(Window.partitionBy()))))


def ensemble_noise(fields: DataFrame, group: str, member: str) -> DataFrame:
    """(group, cell_id, mean, sd) over members of their fields (group, member, cell_id, share); absent cells count 0."""
    n = fields.groupBy(group).agg(F.countDistinct(member).alias("__n"))
    sums = fields.groupBy(group, "cell_id").agg(F.sum("share").alias("__s"), F.sum(F.col("share") * F.col("share")).alias("__q")).join(F.broadcast(n), group)
    mean = F.col("__s") / F.col("__n")
    return sums.select(group, "cell_id", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__n") - mean * mean)).alias("sd"))
