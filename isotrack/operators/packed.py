"""Tests over fields and patterns that shuffle years: a cell's years are one array, and all replicates meet it at once.

A batch of cells is a matrix of cells by years, the shuffled series one of years by replicates; their product holds
every replicate of every cell.  What leaves a task is a row a cell and, for a statistic of the whole field, one
array of a number a replicate for each batch.  Tests that only need products of year with year get those summed over
cells once, and no cell at all afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import cut
from .inference import bh_fdr

DIGITS = 9  # replicates that agree with the observed value to so many decimals are as far out
BATCH = 4_000_000  # numbers of one matrix of cells by replicates


def shuffled_positions(blocks: DataFrame, replicates: int, seed: int, year: str = "season") -> tuple[list, np.ndarray]:
    """Sorted years, and the place of each in every replicate, as ``block_positions`` gives them; replicate 0 keeps the order.  One row a year comes to the driver."""
    rows = sorted((r[0], r[1]) for r in blocks.select(year, "block").collect())
    groups: dict = {}
    for i, (_, b) in enumerate(rows):
        groups.setdefault(b, []).append(i)
    out = np.empty((replicates + 1, len(rows)), np.int64)
    for rep in range(replicates + 1):
        order = sorted(groups) if not rep else sorted(groups, key=lambda b: (hashlib.md5(f"{seed}_{rep}_{b}".encode()).hexdigest(), b))
        out[rep, [i for b in order for i in groups[b]]] = np.arange(len(rows))
    return [y for y, _ in rows], out


def by_cell(field: DataFrame, cell: list[str], v: str, year: str = "season") -> DataFrame:
    """(cell, years, vs): the years of each cell that have a value, as two arrays."""
    known = field.where(F.col(v).isNotNull() & ~F.isnan(v))
    return known.groupBy(*cell).agg(F.collect_list(F.struct(F.col(year).alias("y"), F.col(v).cast("double").alias("v"))).alias("all")).select(*cell, F.col("all.y").alias("years"), F.col("all.v").alias("vs"))


def matrix(pdf: pd.DataFrame, place: dict) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether they are known, cells by years; years that the record lacks are left out."""
    values, known = np.zeros((len(pdf), len(place))), np.zeros((len(pdf), len(place)))
    for i, (years, vs) in enumerate(zip(pdf.years, pdf.vs)):
        pairs = [(place[y], v) for y, v in zip(years, vs) if y in place]
        if pairs:
            at, v = zip(*pairs)
            values[i, list(at)], known[i, list(at)] = v, 1
    return values, known


def chunks(batches: Iterator[pd.DataFrame], replicates: int) -> Iterator[pd.DataFrame]:
    step = max(1, BATCH // (replicates + 1))
    for pdf in batches:
        for k in range(0, len(pdf), step):
            yield pdf.iloc[k : k + step]


def field_tests(field: DataFrame, cell: list[str], series: DataFrame, blocks: DataFrame, x: str, v: str, replicates: int, seed: int, year: str = "season") -> tuple[DataFrame, DataFrame]:
    """Per cell beta, r, p, q of v on the yearly series x, and (global_r2, p_value) of the whole field.

    Years of x are shuffled in blocks.  A cell uses the years that it has; r is 0, and p 1, where x or v does not
    vary over them, beta null where x does not.  global_r2 is the mean of r squared over cells.
    """
    years, positions = shuffled_positions(blocks, replicates, seed, year)
    given = dict(series.select(year, x).collect())  # a row a year
    line = np.array([given[y] for y in years], float)
    trial = line[positions].T - line.mean()
    shipped, place = field.sparkSession.sparkContext.broadcast(trial), {y: i for i, y in enumerate(years)}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in field.select(*cell).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trial = shipped.value
        for pdf in chunks(batches, replicates):
            y, known = matrix(pdf, place)
            n = known.sum(1, keepdims=True)
            y = (y - y.sum(1, keepdims=True) / n) * known
            sx, sxx, sxy, syy = known @ trial, known @ (trial * trial), y @ trial, (y * y).sum(1, keepdims=True)
            var = np.maximum(sxx - sx * sx / n, 0)
            bottom = np.sqrt(var * syy)
            flat = bottom <= 1e-12 * np.sqrt(np.maximum(sxx * syy, 1e-300))
            r = np.where(flat, 0, sxy / np.where(flat, 1, bottom))
            far = np.round(np.abs(r), DIGITS)
            beta = np.where(var[:, 0] > 0, sxy[:, 0] / np.where(var[:, 0] > 0, var[:, 0], 1), np.nan)
            out = pdf[cell].assign(beta=beta, r=r[:, 0], p=((far[:, 1:] >= far[:, :1]).sum(1) + 1) / (replicates + 1), n_cells=0, squares=None)
            yield out.astype({"squares": object})
            yield pd.DataFrame({**{c: [None] for c in cell}, "beta": [np.nan], "r": [np.nan], "p": [np.nan], "n_cells": [len(pdf)], "squares": [(r * r).sum(0)]})

    rows = cut(by_cell(field, cell, v, year).mapInPandas(run, f"{schema}, beta double, r double, p double, n_cells long, squares array<double>"))
    cells = bh_fdr(rows.where("n_cells = 0").select(*cell, F.nanvl("beta", F.lit(None)).alias("beta"), "r", "p"), "p", [])
    sums = rows.where("n_cells > 0").select("n_cells", F.posexplode("squares").alias("rep", "s")).groupBy("rep").agg((F.sum("s") / F.sum("n_cells")).alias("r2"))
    seen = sums.where("rep = 0").select(F.col("r2").alias("seen"))
    part = (F.sum((F.round("r2", DIGITS) >= F.round("seen", DIGITS)).cast("int")) + 1) / F.lit(replicates + 1.0)
    return cells, sums.where("rep > 0").crossJoin(F.broadcast(seen)).agg(F.max("seen").alias("global_r2"), part.alias("p_value"))


def area_significance(field: DataFrame, cell: list[str], lat: str, labels: DataFrame, blocks: DataFrame, v: str, replicates: int, seed: int, one: str, two: str, year: str = "season") -> tuple[DataFrame, DataFrame]:
    """Per cell the difference of mean v between years labelled ``one`` and ``two``, its 2.5 and 97.5 % points when
    labels are shuffled in blocks, and whether it is outside; and (area, p_value): the sum of cos(latitude) over
    such cells, and how often shuffled labels have as much.

    A cell has its own thresholds, so all replicates of a cell are judged where they are made.  A replicate in
    which a cell has no year of either label is no part of its thresholds; labels: (year, label).
    """
    years, positions = shuffled_positions(blocks, replicates, seed, year)
    given = dict(labels.select(year, "label").collect())  # a row a year
    marks = np.array([{one: 1, two: 2}.get(given.get(y), 0) for y in years])[positions].T
    shipped, place = field.sparkSession.sparkContext.broadcast(marks), {y: i for i, y in enumerate(years)}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in field.select(*cell).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = ((shipped.value == k).astype(float) for k in (1, 2))
        for pdf in chunks(batches, replicates):
            y, known = matrix(pdf, place)
            n1, n2 = known @ first, known @ second
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.round((y @ first) / n1 - (y @ second) / n2, DIGITS)
            d[(n1 == 0) | (n2 == 0)] = np.nan
            null = d[:, 1:]
            some = ~np.isnan(null).all(1)
            low, high = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            if some.any():
                low[some], high[some] = np.round(np.nanpercentile(null[some], [2.5, 97.5], axis=1), DIGITS)
            out = (d < low[:, None]) | (d > high[:, None])
            area = np.cos(np.radians(pdf[lat].to_numpy(float)))
            yield pdf[cell].assign(difference=d[:, 0], low=low, high=high, outside=out[:, 0], areas=None).astype({"areas": object})
            yield pd.DataFrame({**{c: [None] for c in cell}, "difference": [np.nan], "low": [np.nan], "high": [np.nan], "outside": [False], "areas": [area @ out]})

    rows = cut(by_cell(field, cell, v, year).mapInPandas(run, f"{schema}, difference double, low double, high double, outside boolean, areas array<double>"))
    known = lambda c: F.nanvl(c, F.lit(None)).alias(c)
    cells = rows.where("areas IS NULL").select(*cell, known("difference"), known("low"), known("high"), "outside")
    sums = rows.where("areas IS NOT NULL").select(F.posexplode("areas").alias("rep", "a")).groupBy("rep").agg(F.sum("a").alias("area"))
    seen = sums.where("rep = 0").select(F.col("area").alias("seen"))
    part = (F.sum((F.round("area", 6) >= F.round("seen", 6)).cast("int")) + 1) / F.lit(replicates + 1.0)
    return cells, sums.where("rep > 0").crossJoin(F.broadcast(seen)).agg(F.max("seen").alias("area"), part.alias("p_value"))


def series_permutation(series: DataFrame, keys: list[str], v: str, blocks: DataFrame, n_early: list[int], replicates: int, seed: int, year: str = "season") -> DataFrame:
    """(keys, n_early, difference, p_value) of every series and cut: late minus early mean of the years it has, and how
    often shuffled blocks of years are as far apart.  All series and cuts share the shuffles; null where a series
    has no year on one side, and a shuffle that leaves a side empty is not as far."""
    years, positions = shuffled_positions(blocks, replicates, seed, year)
    shipped, place = series.sparkSession.sparkContext.broadcast(positions.T), {y: i for i, y in enumerate(years)}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, replicates):
            y, known = matrix(pdf, place)
            for n in n_early:
                late = (shipped.value >= n).astype(float)
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = (y @ late) / (known @ late) - (y @ (1 - late)) / (known @ (1 - late))
                far = np.round(np.abs(d), DIGITS)
                p = ((far[:, 1:] >= far[:, :1]).sum(1) + 1) / (replicates + 1)
                yield pdf[keys].assign(n_early=n, difference=d[:, 0], p_value=np.where(np.isnan(d[:, 0]), np.nan, p))

    out = by_cell(series, keys, v, year).mapInPandas(run, f"{schema}, n_early int, difference double, p_value double")
    return out.select(*keys, "n_early", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("difference", "p_value")])


def cutpoint_fields(shares: DataFrame, blocks: DataFrame, n_early: list[int], replicates: int, seed: int, year: str = "season") -> DataFrame:
    """(n_early, tv, p_value) of every cut: half the absolute change of cells' mean shares from the first years to all
    the rest, and how often shuffled blocks of years change as much.  One pass over cells serves all cuts; absent cells of a year are 0."""
    years, positions = shuffled_positions(blocks, replicates, seed, year)
    shipped, place = shares.sparkSession.sparkContext.broadcast(positions.T), {y: i for i, y in enumerate(years)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, replicates):
            y, _ = matrix(pdf, place)
            for n in n_early:
                late = shipped.value >= n
                yield pd.DataFrame({"n_early": [n], "half": [np.abs(y @ (late / (len(years) - n) - ~late / n)).sum(0) / 2]})

    sums = by_cell(shares, ["cell_id"], "share", year).mapInPandas(run, "n_early int, half array<double>")
    tv = cut(sums.select("n_early", F.posexplode("half").alias("rep", "h")).groupBy("n_early", "rep").agg(F.sum("h").alias("tv")))
    seen = tv.where("rep = 0").select("n_early", F.col("tv").alias("seen"))
    part = (F.sum((F.round("tv", DIGITS) >= F.round("seen", DIGITS)).cast("int")) + 1) / F.lit(replicates + 1.0)
    return tv.where("rep > 0").join(F.broadcast(seen), "n_early").groupBy("n_early").agg(F.first("seen").alias("tv"), part.alias("p_value"))  # a row a cut


def year_products(shares: DataFrame, keys: list[str], year: str = "season") -> DataFrame:
    """(keys, years, gram): products of year with year summed over cells, as one array by rows; absent cells are 0."""
    side = lambda k: shares.select(*keys, "cell_id", F.col(year).alias(f"y{k}"), F.col("share").alias(f"s{k}"))
    g = side(1).join(side(2), [*keys, "cell_id"]).groupBy(*keys, "y1", "y2").agg(F.sum(F.col("s1") * F.col("s2")).alias("g"))
    years = F.array_sort(F.collect_set("y1"))
    out = g.groupBy(*keys).agg(years.alias("years"), F.map_from_entries(F.collect_list(F.struct(F.struct("y1", "y2"), "g"))).alias("m"))
    full = F.flatten(F.transform("years", lambda a: F.transform("years", lambda b: F.coalesce(F.element_at("m", F.named_struct(F.lit("y1"), a, F.lit("y2"), b)), F.lit(0.0)))))
    return out.select(*keys, "years", full.alias("gram"))


def left_out_scores(gram: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Projection score of every year on the pattern of all others, from products of year with year; ``late`` marks the later period."""
    n, eye = len(late), np.eye(len(late))
    mean = {}
    for k in (False, True):
        own = late == k
        whole = np.broadcast_to(own.astype(float), (n, n))
        mean[k] = np.where(own[:, None], (whole - eye) / (own.sum() - 1), whole / own.sum())
    pattern, rest = mean[True] - mean[False], eye - (mean[True] + mean[False]) / 2
    along, size = ((rest @ gram) * pattern).sum(1), ((pattern @ gram) * pattern).sum(1)
    return 2 * along / size


def separation(scores: np.ndarray, late: np.ndarray) -> float:
    return scores[late].mean() - scores[~late].mean()


def projection_permutation(shares: DataFrame, blocks: DataFrame, n_early: int, replicates: int, seed: int, year: str = "season") -> DataFrame:
    """(separation, p_value): how far the periods' left-out scores are apart, and how often as far when years are
    shuffled in blocks and the pattern is fitted anew each time.  Cells are summed once; replicates are spread."""
    spark = shares.sparkSession
    years, positions = shuffled_positions(blocks, replicates, seed, year)
    found = year_products(shares, [], year).first()  # years by years
    shipped = spark.sparkContext.broadcast((np.array(found.gram).reshape(len(found.years), -1), positions))
    if list(found.years) != years:
        raise ValueError("the blocks must hold the years of the shares")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, positions = shipped.value
        for pdf in batches:
            marks = [positions[rep] >= n_early for rep in pdf.rep]
            yield pd.DataFrame({"rep": pdf.rep, "d": [separation(left_out_scores(gram, m), m) for m in marks]})

    d = spark.range(replicates + 1).select(F.col("id").cast("int").alias("rep")).mapInPandas(run, "rep int, d double")
    d = cut(d)
    seen = d.where("rep = 0").select(F.col("d").alias("seen"))
    part = (F.sum((F.round(F.abs("d"), 7) >= F.round(F.abs("seen"), 7)).cast("int")) + 1) / F.lit(replicates + 1.0)
    return d.where("rep > 0").crossJoin(F.broadcast(seen)).agg(F.max("seen").alias("separation"), part.alias("p_value"))


PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]  # 1, 2, 3 and 5 of xxHash64


def xxhash_then(state: np.ndarray, number: int) -> np.ndarray:
    """``F.xxhash64(..., number)`` from the hash ``state`` of what comes before the number, an int of 32 bits."""
    one, two, three, five = PRIMES
    with np.errstate(over="ignore"):
        h = (state.view(np.uint64) + (five + np.uint64(4))) ^ (np.uint64(number & 0xFFFFFFFF) * one)
        h = (h << np.uint64(23) | h >> np.uint64(41)) * two + three
        h = (h ^ h >> np.uint64(33)) * two
        h = (h ^ h >> np.uint64(29)) * three
        return (h ^ h >> np.uint64(32)).view(np.int64)


def dealt_counts(points: DataFrame, id_: str, years: list[int], trials: int, year: str = "season") -> DataFrame:
    """(trial, year, cell_id, n): points of each cell and year, their years dealt anew in every trial by a hash of id and trial.

    A task counts its points for all trials at once; what leaves it is a row a trial and cell, whose years are one array.
    """
    n = len(years)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict = {}
        counts = np.zeros((trials, 0), np.int64)
        for pdf in batches:
            cells, own = np.unique(pdf.cell_id.to_numpy(), return_inverse=True)
            own = np.array([places.setdefault(int(c), len(places)) for c in cells], np.int64)[own] * n if len(cells) else own
            counts = np.pad(counts, ((0, 0), (0, len(places) * n - counts.shape[1])))
            state = pdf.state.to_numpy()
            for trial in range(trials):
                counts[trial] += np.bincount(own + xxhash_then(state, trial) % n, minlength=counts.shape[1])
        for trial in range(trials if places else 0):
            yield pd.DataFrame({"trial": np.full(len(places), trial, np.int32), "cell_id": np.array(list(places), np.int32), "ns": list(counts[trial].reshape(-1, n))})

    parts = points.select(F.col("cell_id").cast("int").alias("cell_id"), F.xxhash64(id_).alias("state")).mapInPandas(run, "trial int, cell_id int, ns array<bigint>")
    sums = parts.groupBy("trial", "cell_id").agg(F.array(*[F.struct(F.lit(y).alias(year), F.sum(F.get("ns", F.lit(i))).alias("n")) for i, y in enumerate(years)]).alias("all"))
    return sums.select("trial", "cell_id", F.inline("all")).where("n > 0").select("trial", year, "cell_id", "n")


def null_calibration(trials: DataFrame, blocks: DataFrame, n_early: int, replicates: int, seed: int, year: str = "season") -> DataFrame:
    """(trial, fixed_p, refit_p): the p value of each simulated set of shares (trial, year, cell_id, share), with
    scores fitted once and shuffled, and with the pattern fitted anew in every shuffle.

    A trial's shuffles are its own, drawn by a hash; trials are spread over tasks, each a matrix of year by year.
    """
    years, _ = shuffled_positions(blocks, 0, seed, year)
    numbers = dict(blocks.select(year, "block").collect())  # a row a year
    groups: dict = {}
    for i, y in enumerate(years):
        groups.setdefault(numbers[y], []).append(i)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for trial, gram in zip(pdf.trial, pdf.gram):
                gram = np.asarray(gram).reshape(len(years), -1)
                late = np.arange(len(years)) >= n_early
                scores = left_out_scores(gram, late)
                seen, fixed, refit = round(abs(separation(scores, late)), 7), 0, 0
                for rep in range(1, replicates + 1):
                    order = sorted(groups, key=lambda b: (hashlib.md5(f"{seed}_{trial}_{rep}_{b}".encode()).hexdigest(), b))
                    marks = np.empty(len(years), bool)
                    marks[[i for b in order for i in groups[b]]] = late
                    fixed += round(abs(separation(scores, marks)), 7) >= seen
                    refit += round(abs(separation(left_out_scores(gram, marks), marks)), 7) >= seen
                out.append((trial, (fixed + 1) / (replicates + 1), (refit + 1) / (replicates + 1)))
            yield pd.DataFrame(out, columns=["trial", "fixed_p", "refit_p"])

    products = cut(year_products(trials, ["trial"], year))  # a row a trial, read twice
    if not products.where(F.size("years") != len(years)).isEmpty():
        raise ValueError("every trial must have all years")
    return products.select("trial", "gram").mapInPandas(run, "trial int, fixed_p double, refit_p double")


def rejection_rates(calibration: DataFrame, levels: tuple[float, ...] = (0.10, 0.05, 0.01)) -> DataFrame:
    """(statistic, trials, median_p, and the share of p values at or under each level)."""
    long = calibration.select(F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("p")) for c in ("fixed_p", "refit_p")])))
    return long.groupBy("statistic").agg(F.count("*").alias("trials"), F.median("p").alias("median_p"), *[F.avg((F.col("p") <= a).cast("double")).alias(f"at_{int(round(a * 100))}") for a in levels])
