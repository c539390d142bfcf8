"""How decompositions and contrasts depend on periods, domains, denominators and the rows that enter.

Scenarios are rows: each is a vector of year weights, or a domain, and all of them meet what the points were reduced
to once.  A table of scenarios has the size of the study's design, not of the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from .density import bin_index
from .packed import DIGITS, by_cell, chunks, matrix
from .resampled import between_shares, by_year, dot, label_permutations, summary

Period = tuple[int, int]


def group_moments(events: DataFrame, members: DataFrame, group: str, value: str, year: str = "season", entity: str = "sid") -> DataFrame:
    """(year, group, pi, moment): mean membership of a year's events in a group, and mean of membership times value.

    events: (year, entity, value), one row an entity and year; members: (year, entity, group, m), an entity's m summing
    to 1.  Events without membership or value don't count.
    """
    rows = events.where(F.col(value).isNotNull()).join(members, [year, entity])
    n = rows.groupBy(year).agg(F.count_distinct(entity).alias("__n"))
    sums = rows.groupBy(year, group).agg(F.sum("m").alias("pi"), F.sum(F.col("m") * F.col(value)).alias("moment"))
    return sums.join(F.broadcast(n), year).select(year, group, (F.col("pi") / F.col("__n")).alias("pi"), (F.col("moment") / F.col("__n")).alias("moment"))  # a row a year


def moment_groups(moments: DataFrame, weights: DataFrame, group: str, year: str = "season") -> DataFrame:
    """(rep, group, pi_early, pi_late, mu_early, mu_late, between, within, change) of ``group_moments`` under year weights.

    A group's mean value mu is its moment over its share pi; the change of pi * mu is dpi * mean mu (between) plus mean
    pi * dmu (within), exactly.  Both are null for a group that a period lacks.
    """
    packed = by_year(moments, [group], "pi", "p", year).join(by_year(moments, [group], "moment", "q", year), group)
    held = weights.crossJoin(F.broadcast(packed)).select("rep", group, *[dot(side, v).alias(f"{v}{side[0]}") for side in ("early", "late") for v in "pq"])  # groups are few
    held = held.withColumns({"mu_early": F.try_divide("qe", "pe"), "mu_late": F.try_divide("ql", "pl")})
    between = (F.col("pl") - F.col("pe")) * (F.col("mu_late") + F.col("mu_early")) / 2
    within = (F.col("pl") + F.col("pe")) / 2 * (F.col("mu_late") - F.col("mu_early"))
    return held.select(
        "rep", group, F.col("pe").alias("pi_early"), F.col("pl").alias("pi_late"), "mu_early", "mu_late", between.alias("between"), within.alias("within"), (F.col("ql") - F.col("qe")).alias("change"),
        F.col("qe").alias("moment_early"), F.col("ql").alias("moment_late"),
    )


def moment_change(groups: DataFrame) -> DataFrame:
    """(rep, mean_early, mean_late, change, between, within, closure_abs) of ``moment_groups``; parts are null if a group is missing from a period."""
    whole = F.count(F.when(F.col("between").isNull(), 1)) == 0
    out = groups.groupBy("rep").agg(
        F.sum("moment_early").alias("mean_early"), F.sum("moment_late").alias("mean_late"), F.sum("change").alias("change"),
        F.when(whole, F.sum("between")).alias("between"), F.when(whole, F.sum("within")).alias("within"),
    )
    return out.withColumn("closure_abs", F.abs(F.col("change") - F.col("between") - F.col("within")))


def moment_bootstrap(groups: DataFrame) -> DataFrame:
    """Intervals of the change and its parts over the replicates of ``moment_groups``."""
    return summary(moment_change(groups), ["change", "between", "within"])


def period_weights(years: DataFrame, scenarios: list[tuple[str, int, int, int]], year: str = "season") -> DataFrame:
    """(scenario, start, cutpoint, end, n_early, n_late, early, late): weights of all years, in their order, for each (scenario,
    start, first late year, end).  Periods are whole: both have two years or more, and the record has all of theirs."""
    held = sorted(r[0] for r in years.select(year).distinct().collect())  # a row a year
    rows = []
    for name, start, cutpoint, end in scenarios:
        early, late = range(start, cutpoint), range(cutpoint, end + 1)
        if len(early) < 2 or len(late) < 2:
            raise ValueError(f"{name}: each period must have two years or more")
        lacking = sorted({*early, *late} - set(held))
        if lacking:
            raise ValueError(f"{name}: years that the record lacks: {lacking}")
        rows.append((name, start, cutpoint, end, len(early), len(late), *[[1 / len(p) if y in p else 0.0 for y in held] for p in (early, late)]))
    return years.sparkSession.createDataFrame(rows, "scenario string, start int, cutpoint int, end int, n_early int, n_late int, early array<double>, late array<double>")


def period_sensitivity(joint: DataFrame, weights: DataFrame, group: str, year: str = "season") -> DataFrame:
    """Shares of a change between and within groups for each scenario of ``period_weights``; joint as for ``between_bootstrap``.

    Points are reduced to an array of years a group and cell once, whatever the number of scenarios.
    """
    names = ["scenario", "start", "cutpoint", "end", "n_early", "n_late"]
    cells = by_year(joint, [group, "cell_id"], "share", "a", year)
    means = cells.crossJoin(F.broadcast(weights)).select(*names, group, "cell_id", dot("early", "a").alias("je"), dot("late", "a").alias("jl"))  # a row a scenario
    of = Window.partitionBy("scenario", group)
    return between_shares(means.withColumns({"pe": F.sum("je").over(of), "pl": F.sum("jl").over(of)}), names)


def inside_domains(points: DataFrame, domains: list[tuple[str, tuple, float, bool]], year: str = "season", entity: str = "sid") -> tuple[DataFrame, DataFrame]:
    """Shares of cells, and the entities that count, under several domains; points are read once for all.

    domains: (mode, (west, east, south, north), cell width, fixed).  An entity's points in a cell are divided by its
    points inside the domain, or by all of its points if ``fixed``; without points inside it counts under fixed
    denominators only.  Returns (mode, year, entity, cell_id, n, share) and (mode, year, entity, inside, total).
    """
    def mode(name: str, box: tuple, width: float, fixed: bool) -> Column:
        west, east, south, north = box
        cell = bin_index(F.col("lat"), south, north, width) * int(round((east - west) / width)) + bin_index(F.col("lon"), west, east, width)
        return F.struct(F.lit(name).alias("mode"), cell.alias("cell_id"))

    each = points.select(year, entity, F.inline(F.array(*[mode(*d) for d in domains]))).groupBy("mode", year, entity, "cell_id").agg(F.count("*").alias("n"))
    of = each.groupBy("mode", year, entity).agg(F.coalesce(F.sum(F.when(F.col("cell_id").isNotNull(), F.col("n"))), F.lit(0)).alias("inside"), F.sum("n").alias("total"))
    fixed = F.col("mode").isin([d[0] for d in domains if d[3]])
    valid = of.where(fixed | (F.col("inside") > 0))
    shares = each.where("cell_id IS NOT NULL").join(valid, ["mode", year, entity])
    return shares.select("mode", year, entity, "cell_id", "n", (F.col("n") / F.when(fixed, F.col("total")).otherwise(F.col("inside"))).alias("share")), of.withColumn("valid", fixed | (F.col("inside") > 0))


def domain_sensitivity(points: DataFrame, members: DataFrame, domains: list[tuple[str, tuple, float, bool]], group: str, early: Period, late: Period, year: str = "season", entity: str = "sid") -> DataFrame:
    """For each domain: what of entities and points it holds, the mass of both periods, and the change between and within groups.

    members: (year, entity, group, m), an entity's m of a year summing to 1.  Entities weigh alike in a year, years
    that have any alike in a period.
    """
    shares, entities = inside_domains(points, domains, year, entity)
    held = entities.groupBy("mode").agg(F.avg(F.col("valid").cast("double")).alias("valid_fraction"), (F.sum("inside") / F.sum("total")).alias("coverage"))
    valid = entities.where("valid").select("mode", year, entity)
    period = F.when(F.col(year).between(*early), "e").when(F.col(year).between(*late), "l")
    per = valid.groupBy("mode", year).agg(F.count("*").alias("ny")).withColumn("p", period).where("p IS NOT NULL")
    per = per.withColumn("w", 1 / (F.col("ny") * F.count("*").over(Window.partitionBy("mode", "p")))).select("mode", year, "p", "w")  # a row a mode and year
    side = lambda x, p: F.sum(F.when(F.col("p") == p, x).otherwise(0.0))
    weighed = members.join(F.broadcast(per), year)
    pi = weighed.join(valid, ["mode", year, entity]).groupBy("mode", group).agg(*[side(F.col("m") * F.col("w"), p).alias(f"p{p}") for p in "el"])
    parts = shares.join(weighed, ["mode", year, entity])
    means = parts.groupBy("mode", group, "cell_id").agg(*[side(F.col("share") * F.col("m") * F.col("w"), p).alias(f"j{p}") for p in "el"])
    mass = means.groupBy("mode").agg(F.sum("je").alias("mass_early"), F.sum("jl").alias("mass_late"))
    split = between_shares(means.join(F.broadcast(pi), ["mode", group]), ["mode"])  # a row a mode and group
    return held.join(mass, "mode").join(split, "mode")


def domain_null(points: DataFrame, labels: DataFrame, domains: list[tuple[str, tuple, float, bool]], replicates: int, seed: int, year: str = "season", entity: str = "sid") -> DataFrame:
    """``label_permutation`` for each domain, all in one pass, with the columns mode and those of the test; labels: (year, entity, period, label)."""
    shares, entities = inside_domains(points, domains, year, entity)
    held = labels.join(entities.where("valid").select("mode", year, entity), [year, entity])
    seeds = {mode: seed + i for i, (mode, *_) in enumerate(domains)}
    tests = label_permutations(shares.withColumnRenamed(entity, "sid"), held.withColumnRenamed(entity, "sid"), ["mode"], seeds, replicates, year)
    return tests.select(F.get(F.array(*map(F.lit, seeds)), F.col("test")).alias("mode"), *[c for c in tests.columns if c != "test"])


def field_shares(points: DataFrame, fields: list[tuple[str, Column, float]], box: tuple = (100.0, 180.0, 0.0, 40.0), year: str = "season", entity: str = "sid") -> DataFrame:
    """(field, weighting, year, cell_id, share) of several selections of points, under cells of several widths, in one pass.

    fields: (name, which points, cell width).  ``point``: every point counts 1; ``entity``: every entity counts 1 a year.
    """
    west, east, south, north = box

    def one(name: str, where: Column, width: float) -> Column:
        cell = bin_index(F.col("lat"), south, north, width) * int(round((east - west) / width)) + bin_index(F.col("lon"), west, east, width)
        return F.struct(F.lit(name).alias("field"), F.when(where, cell).alias("cell_id"))

    rows = points.select(year, entity, F.inline(F.array(*[one(*f) for f in fields]))).where("cell_id IS NOT NULL")
    counts = rows.groupBy("field", year, entity, "cell_id").agg(F.count("*").alias("n"))
    own = counts.withColumn("own", F.sum("n").over(Window.partitionBy("field", year, entity)))
    cells = own.groupBy("field", year, "cell_id").agg(F.sum("n").cast("double").alias("point"), F.sum(F.col("n") / F.col("own")).alias("entity"))
    long = cells.select("field", year, "cell_id", F.inline(F.array(*[F.struct(F.lit(w).alias("weighting"), F.col(w).alias("mass")) for w in ("point", "entity")])))
    return long.withColumn("share", F.col("mass") / F.sum("mass").over(Window.partitionBy("field", "weighting", year))).drop("mass")  # cells of one field and year


CONTRASTS = "analysis string, field string, weighting string, block int, early_start int, early_end int, late_start int, late_end int, n_early int, n_late int, against string, cells long"


def contrasts(shares: DataFrame, design: list[dict], year: str = "season") -> tuple[DataFrame, dict]:
    """The ``design`` as a table, with a number ``config``, and the years of each configuration, early ones first.

    An entry has analysis, field, weighting, block, early and late (first and last year), without (left-out years, or
    none), against (the analysis whose change it is compared with, of the same field and weighting, or None) and cells
    (of the whole grid).
    """
    held = sorted(r[0] for r in shares.select(year).distinct().collect())  # a row a year
    rows, years = [], {}
    for i, c in enumerate(design):
        kept = [y for y in held if y not in (c.get("without") or ())]
        early, late = ([y for y in kept if c[p][0] <= y <= c[p][1]] for p in ("early", "late"))
        if not early or not late:
            raise ValueError(f"{c['analysis']}: a period without years")
        years[i] = (early, late)
        rows.append((i, c["analysis"], c["field"], c["weighting"], c["block"], *c["early"], *c["late"], len(early), len(late), c.get("against"), c["cells"]))
    return shares.sparkSession.createDataFrame(rows, f"config int, {CONTRASTS}"), years


def observed_contrasts(shares: DataFrame, design: list[dict], year: str = "season") -> DataFrame:
    """(config, ..., tv, corr): half the absolute change of cells' mean shares, and how far its map agrees with the one it is compared
    with, over all cells of the grid.  Absent cells of a year are 0; the correlation with a constant map is null."""
    table, years = contrasts(shares, design, year)
    w = [(i, y, s / len(p)) for i, both in years.items() for s, p in zip((-1.0, 1.0), both) for y in p]
    w = shares.sparkSession.createDataFrame(w, f"config int, {year} {dict(shares.dtypes)[year]}, w double").join(F.broadcast(table), "config")
    keys = ["config", "field", "weighting"]
    change = shares.join(F.broadcast(w.select(*keys, year, "w")), ["field", "weighting", year]).groupBy(*keys, "cell_id").agg(F.sum(F.col("share") * F.col("w")).alias("d"))
    change = cut(change)  # configurations times cells of the grid
    tv = change.groupBy("config").agg((F.sum(F.abs("d")) / 2).alias("tv"), F.sum("d").alias("x"), F.sum(F.col("d") * F.col("d")).alias("xx"))
    pair = table.join(table.select(F.col("config").alias("base"), F.col("analysis").alias("against"), "field", "weighting"), ["against", "field", "weighting"]).select("config", "base")
    other = change.select(F.col("config").alias("base"), "cell_id", F.col("d").alias("b"))
    both = change.select("config", "cell_id", "d").join(F.broadcast(pair), "config").join(other, ["base", "cell_id"]).groupBy("config", "base").agg(F.sum(F.col("d") * F.col("b")).alias("xy"))
    both = both.join(tv.select(F.col("config").alias("base"), F.col("x").alias("y"), F.col("xx").alias("yy")), "base").drop("base")
    n = F.col("cells")
    spread = (n * F.col("xx") - F.col("x") ** 2) * (n * F.col("yy") - F.col("y") ** 2)
    corr = F.when(spread > 0, (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread))
    return table.join(tv, "config").join(both, "config", "left").select(*table.columns, "tv", corr.alias("corr"))


def shuffled(early: list, late: list, block: int, replicates: int, seed: int) -> np.ndarray:
    """Weights of the years (early ones first) in every replicate, late mean less early one; replicate 0 as observed.

    Blocks of years are put in the order of a hash; no block spans years that are left out.
    """
    years, blocks = sorted(early + late), []
    for y in years:
        if blocks and blocks[-1][-1] == y - 1 and len(blocks[-1]) < block:
            blocks[-1].append(y)
        else:
            blocks.append([y])
    at = {y: i for i, y in enumerate(early + late)}
    out = np.empty((replicates + 1, len(years)))
    for rep in range(replicates + 1):
        order = range(len(blocks)) if not rep else sorted(range(len(blocks)), key=lambda b: (hashlib.md5(f"{seed}_{rep}_{b}".encode()).hexdigest(), b))
        moved = [at[y] for b in order for y in blocks[b]]
        out[rep, moved[: len(early)]], out[rep, moved[len(early) :]] = -1 / len(early), 1 / len(late)
    return out


def robustness_matrix(shares: DataFrame, design: list[dict], replicates: int, seed: int, year: str = "season") -> DataFrame:
    """``observed_contrasts`` with p_value: how often shuffled blocks of years change as much, for each configuration of the design.

    A cell's years are one array, read once for all configurations of its field; a batch of cells meets a configuration's
    shuffles as one matrix product, and one array of sums leaves the task for each.
    """
    table, years = contrasts(shares, design, year)
    weights = {i: (early + late, shuffled(early, late, design[i]["block"], replicates, seed).T) for i, (early, late) in years.items()}
    of: dict = {}
    for i, c in enumerate(design):
        of.setdefault((c["field"], c["weighting"]), []).append(i)
    shipped = shares.sparkSession.sparkContext.broadcast((weights, of))  # years times replicates of each configuration

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, of = shipped.value
        for pdf in chunks(batches, replicates):
            for key, own in pdf.groupby(["field", "weighting"]):
                for i in of.get(key, ()):
                    order, w = weights[i]
                    values, _ = matrix(own, {y: k for k, y in enumerate(order)})
                    yield pd.DataFrame({"config": [i], "half": [np.abs(values @ w).sum(0) / 2]})

    sums = by_cell(shares, ["field", "weighting", "cell_id"], "share", year).mapInPandas(run, "config int, half array<double>")
    tv = cut(sums.select("config", F.posexplode("half").alias("rep", "h")).groupBy("config", "rep").agg(F.sum("h").alias("v")))
    seen = tv.where("rep = 0").select("config", F.col("v").alias("seen"))
    part = (F.sum((F.round("v", DIGITS) >= F.round("seen", DIGITS)).cast("int")) + 1) / F.lit(replicates + 1.0)
    p = tv.where("rep > 0").join(F.broadcast(seen), "config").groupBy("config").agg(part.alias("p_value"))  # a row a configuration
    return observed_contrasts(shares, design, year).join(p, "config")


def group_composites(members: DataFrame, field: DataFrame, group: str, cell: list[str], values: list[str], time: str = "season") -> DataFrame:
    """(group, cell, n_times, means): the fields averaged over the times at which a group has members, each time once; null values don't count.

    members: (group, time, ...); field: (time, cell, values).
    """
    times = members.select(group, time).where(F.col(group).isNotNull()).distinct()
    return field.join(times, time).groupBy(group, *cell).agg(F.count("*").alias("n_times"), *[F.avg(v).alias(v) for v in values])
