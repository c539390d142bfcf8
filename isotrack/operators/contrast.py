"""Contrasts and exact decompositions between two periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .density import period_means


def total_variation(shares: DataFrame, early: tuple[int, int], late: tuple[int, int], year: str = "season") -> DataFrame:
    return period_means(shares, early, late, year).agg((F.lit(0.5) * F.sum(F.abs(F.col("late") - F.col("early")))).alias("tv"))


def projection_index(shares: DataFrame, early: tuple[int, int], late: tuple[int, int], year: str = "season") -> DataFrame:
    """Each year's place on the line between the period means, in units of half their distance.

    2 (f - mid) . p / (p . p) with p = late - early: -1 at the early mean, 1 at the late one.
    """
    means = period_means(shares, early, late, year)
    fixed = means.agg(F.sum((F.col("late") - F.col("early")) ** 2).alias("pp"), F.sum((F.col("late") + F.col("early")) / 2 * (F.col("late") - F.col("early"))).alias("mp"))
    dots = shares.join(means, "cell_id").groupBy(year).agg(F.sum(F.col("share") * (F.col("late") - F.col("early"))).alias("fp"))
    return dots.join(F.broadcast(fixed)).select(year, F.try_divide(2 * (F.col("fp") - F.col("mp")), F.col("pp")).alias("index"))


def between_within(joint: DataFrame, group: str, early: tuple[int, int], late: tuple[int, int], year: str = "season") -> DataFrame:
    """Change of each cell's share as a change between groups plus a change within them.

    joint: (year, group, cell_id, share), a year's shares summing to 1.  With group shares pi and
    conditionals g, the change is sum of dpi * mean g (between) + mean pi * dg (within), exactly.
    """
    n = joint.select(year).distinct().agg(*[F.sum(F.col(year).between(*p).cast("int")).alias(k) for p, k in ((early, "ne"), (late, "nl"))])
    cells = joint.groupBy(group, "cell_id").agg(*[F.sum(F.when(F.col(year).between(*p), F.col("share")).otherwise(0.0)).alias(k) for p, k in ((early, "se"), (late, "sl"))])
    cells = cells.join(F.broadcast(n)).select(group, "cell_id", (F.col("se") / F.col("ne")).alias("je"), (F.col("sl") / F.col("nl")).alias("jl"))
    own = Window.partitionBy(group)
    cells = cells.withColumns({"pe": F.sum("je").over(own), "pl": F.sum("jl").over(own)})
    ge, gl = F.coalesce(F.try_divide("je", "pe"), F.lit(0.0)), F.coalesce(F.try_divide("jl", "pl"), F.lit(0.0))
    return cells.groupBy("cell_id").agg(
        F.sum((F.col("pl") - F.col("pe")) * (ge + gl) / 2).alias("between"), F.sum((F.col("pe") + F.col("pl")) / 2 * (gl - ge)).alias("within"), F.sum(F.col("jl") - F.col("je")).alias("change"),
    )


def exposure_change(state: DataFrame, early: tuple[int, int], late: tuple[int, int], year: str = "season") -> DataFrame:
    """Change of the mean of sum(w h) as redistribution P, state change O and change of covariation.

    state: (year, cell_id, w, h), complete over years and cells.
    """
    stats = state.groupBy("cell_id").agg(*[F.avg(F.when(F.col(year).between(*p), F.col(c) if c != "wh" else F.col("w") * F.col("h"))).alias(f"{c}_{k}") for p, k in ((early, "e"), (late, "l")) for c in ("w", "h", "wh")])
    out = stats.agg(
        F.sum(F.col("wh_l") - F.col("wh_e")).alias("delta"), F.sum((F.col("w_l") - F.col("w_e")) * (F.col("h_e") + F.col("h_l")) / 2).alias("redistribution"),
        F.sum((F.col("w_e") + F.col("w_l")) / 2 * (F.col("h_l") - F.col("h_e"))).alias("state_change"),
    )
    return out.withColumn("covariation", F.col("delta") - F.col("redistribution") - F.col("state_change"))


def three_term(segs: DataFrame, early: tuple[int, int], late: tuple[int, int], year: str = "season") -> DataFrame:
    """Change of the mean speed as shift between latitude bands, change inside bands, and both together.

    Years are weighted alike; a band without segments in a period takes its mean over the other.
    """
    per = segs.withColumn("band", F.floor("lat")).groupBy(year, "band").agg(F.count("*").alias("n"), F.avg("speed").alias("v"))
    per = per.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy(year)))
    n = per.select(year).distinct().agg(*[F.sum(F.col(year).between(*p).cast("int")).alias(k) for p, k in ((early, "ne"), (late, "nl"))])
    band = per.groupBy("band").agg(*[F.sum(F.when(F.col(year).between(*p), F.col(c)).otherwise(0.0)).alias(f"{a}{k}") for p, k in ((early, "e"), (late, "l")) for c, a in (("f", "f"),)], *[F.avg(F.when(F.col(year).between(*p), F.col("v"))).alias(f"v{k}") for p, k in ((early, "e"), (late, "l"))])
    band = band.join(F.broadcast(n)).select((F.col("fe") / F.col("ne")).alias("fe"), (F.col("fl") / F.col("nl")).alias("fl"), F.coalesce("ve", "vl").alias("ve"), F.coalesce("vl", "ve").alias("vl"))
    band = band.na.fill(0.0)
    return band.agg(F.sum((F.col("fl") - F.col("fe")) * F.col("ve")).alias("shift"), F.sum(F.col("fe") * (F.col("vl") - F.col("ve"))).alias("regional"), F.sum((F.col("fl") - F.col("fe")) * (F.col("vl") - F.col("ve"))).alias("joint"), F.sum(F.col("fl") * F.col("vl") - F.col("fe") * F.col("ve")).alias("total"))


def shapley(rows: DataFrame, early: tuple[int, int], late: tuple[int, int], start: str = "start", year: str = "season", least: int = 3) -> DataFrame:
    """Change of each cell's mean share as change of starting bins plus change of what follows from a bin.

    rows: (sid, year, iso_time, event_id, start, cell_id).  An entity's bin is ``start`` of its first row of a
    year; its rows share 1, entities share their year, years their period.  Only bins with ``least`` entities in
    both periods take part; the two orders of replacing are averaged.
    """
    period = F.when(F.col(year).between(*early), "e").when(F.col(year).between(*late), "l")
    own = rows.groupBy("sid", year).agg(F.min_by(start, F.struct("iso_time", "event_id")).alias("bin"), F.count("*").alias("n")).withColumn("p", period).where("p IS NOT NULL")
    years = own.groupBy("p", year).agg(F.count("*").alias("ny")).withColumn("years", F.count("*").over(Window.partitionBy("p")))
    own = own.join(years, ["p", year]).withColumn("w", 1 / (F.col("years") * F.col("ny")))
    held = lambda k, c: F.coalesce(F.sum(F.when(F.col("p") == k, c)), F.lit(0.0))
    bins = own.groupBy("bin").agg(*[held(k, F.col("w")).alias(f"w{k}") for k in "el"], *[F.count(F.when(F.col("p") == k, 1)).alias(f"n{k}") for k in "el"]).where((F.col("ne") >= least) & (F.col("nl") >= least))
    everything = Window.partitionBy()  # a row a bin
    bins = bins.select("bin", "we", "wl", *[(F.col(f"w{k}") / F.sum(f"w{k}").over(everything)).alias(f"g{k}") for k in "el"])
    parts = rows.select("sid", year, "cell_id").join(own.join(bins, "bin").withColumn("u", F.col("w") / F.col("n")), ["sid", year])
    cells = parts.groupBy("bin", "cell_id").agg(*[F.first(c).alias(c) for c in ("ge", "gl", "we", "wl")], *[held(k, F.col("u")).alias(f"u{k}") for k in "el"])
    cells = cells.withColumns({f"s{k}": F.col(f"u{k}") / F.col(f"w{k}") for k in "el"})
    return cells.groupBy("cell_id").agg(
        F.sum((F.col("gl") - F.col("ge")) * (F.col("se") + F.col("sl")) / 2).alias("genesis"), F.sum((F.col("ge") + F.col("gl")) / 2 * (F.col("sl") - F.col("se"))).alias("propagation"),
        F.sum(F.col("gl") * F.col("sl") - F.col("ge") * F.col("se")).alias("change"),
    )


def signed_projection(change: DataFrame, pattern: DataFrame) -> DataFrame:
    """How far a change map (cell_id, d) goes along a pattern map, and their correlation over common cells."""
    both = change.select("cell_id", F.col("d").alias("dc")).join(pattern.select("cell_id", F.col("d").alias("dp")), "cell_id")
    return both.agg(F.try_divide(F.sum(F.col("dc") * F.col("dp")), F.sum(F.col("dp") ** 2)).alias("projection"), F.corr("dc", "dp").alias("r"))


def leave_one_out_scores(shares: DataFrame, period: str = "period", year: str = "season") -> DataFrame:
    """Projection score of each year on the pattern of all others: (rep, year, period, score).

    shares: (rep, year, period e or l, cell_id, share), every year with every cell.  A year leaves its own
    period's mean, so the pattern is fitted without it.
    """
    w = Window.partitionBy("rep", "cell_id")
    for k in "el":
        shares = shares.withColumn(f"s{k}", F.sum(F.when(F.col(period) == k, F.col("share")).otherwise(0.0)).over(w)).withColumn(f"n{k}", F.count(F.when(F.col(period) == k, 1)).over(w))
    own = {k: F.col(period) == k for k in "el"}
    mean = {k: F.when(own[k], (F.col(f"s{k}") - F.col("share")) / (F.col(f"n{k}") - 1)).otherwise(F.col(f"s{k}") / F.col(f"n{k}")) for k in "el"}
    pattern, mid = mean["l"] - mean["e"], (mean["l"] + mean["e"]) / 2
    dots = shares.groupBy("rep", year, period).agg(F.sum((F.col("share") - mid) * pattern).alias("a"), F.sum(pattern * pattern).alias("b"))
    return dots.select("rep", year, period, F.try_divide(2 * F.col("a"), F.col("b")).alias("score"))


def cross_products(state: DataFrame, year: str = "season") -> DataFrame:
    """Sum over cells of w in one year times h in another, for all years: (year_w, year_h, product)."""
    a = state.select(F.col(year).alias("year_w"), "cell_id", "w")
    b = state.select(F.col(year).alias("year_h"), "cell_id", "h")
    return a.join(b, "cell_id").groupBy("year_w", "year_h").agg(F.sum(F.col("w") * F.col("h")).alias("product"))
