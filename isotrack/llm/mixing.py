"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that runs linearly from ``w0`` to ``w1`` over the
training run.  The integral of that schedule is its share of the budget; a
source can be repeated at most ``max_epochs`` times, and what the cap takes
away is shared again by weight.  Inside a source the documents form a stream in
an order fixed by a hash of their id; the cumulative demand, inverted, gives
the moment of the run at which each copy of a document is read.  A range sort
by that moment is the training order.  Only DataFrame functions are used.

Defined results: null text has size 0; null sources form one source, last in
order; a document of size 0 takes 0; repeated rows are separate documents of
the stream; documents without an id are ordered by a hash of their text; equal
places of the stream go by size in ``allocate``, by text, size and row in
``curriculum``; texts of any length count whole; other columns, whatever their
names, stay as they are; no documents, no rows.

The table of sources, one row each, is walked in one task.  ``allocate`` counts the copy at which a source's budget
ends in part, so that sources meet their targets to the word; ``curriculum``
takes whole copies only (``whole_copies``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, only_last_table_stays, stage, unused, with_prefix

MAX_EPOCHS = 3


def cycle_123(rank: Column) -> tuple[Column, Column]:
    """Weights 1, 2, 3, repeating in the order of the sources, as integrals of a
    schedule that falls for odd ranks and rises for even ones."""
    weight = (rank % 3 + 1).cast("double")
    falls = rank % 2 == 0
    return weight * F.when(falls, 1.5).otherwise(0.5), weight * F.when(falls, 0.5).otherwise(1.5)


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def targets(sizes: DataFrame, schedule: Callable[[Column], tuple[Column, Column]] = cycle_123, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_key, source_size, w0, w1, target): one row per source.

    Capped sources are those with the least capacity per weight; walking the
    sources in that order, the level is what remains per remaining weight, and
    the first source under its own cap fixes it for all that follow.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy("source_key")) - 1)
    w0, w1 = schedule(F.col("rank"))
    per = per.select("*", w0.alias("w0"), w1.alias("w1")).withColumn("weight", (F.col("w0") + F.col("w1")) / 2)
    per = per.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", "source_key")
    used = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - used) / left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("source_key"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return per.select("source_key", "source_size", "w0", "w1", target.alias("target"))


def moment(demand: Column, w0: Column, w1: Column) -> Column:
    """The time t in [0, 1] by which a linear schedule has asked for the fraction ``demand``."""
    slope, start = (w1 - w0) / (w0 + w1), 2 * w0 / (w0 + w1)  # demand = start * t + slope * t^2
    return F.when(F.abs(slope) < 1e-12, demand).otherwise((F.sqrt(start * start + 4 * slope * demand) - start) / (2 * slope))


def n_words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def streams(sizes: DataFrame, order: list[str], schedule: Callable[[Column], tuple[Column, Column]], max_epochs: int) -> DataFrame:
    """``sizes`` with ``before``, the words ahead of each document in its source's stream, and the columns of ``targets``."""
    sizes = stage(sizes, "sizes")
    rows = with_prefix(sizes, ["source_key"], F.substring("order_key", 1, 3), order, "size", "before")
    return rows.join(stage(targets(sizes, schedule, max_epochs), "targets"), "source_key")


def budgeted(rows: DataFrame, max_epochs: int) -> DataFrame:
    """``rows`` of ``streams`` with ``copies``: (epoch, taken, position) of every copy that takes words."""
    budget = F.round("target").cast("long")

    def copy(e: int) -> Column:
        start = F.col("before") + e * F.col("source_size")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), budget - start))
        return F.struct(F.lit(e).alias("epoch"), taken.cast("long").alias("taken"), F.when(taken > 0, moment(start / F.col("target"), F.col("w0"), F.col("w1"))).alias("position"))

    return rows.withColumn("copies", F.filter(F.array(*[copy(e) for e in range(max_epochs)]), lambda c: c["taken"] > 0))


def allocate(docs: DataFrame, schedule: Callable[[Column], tuple[Column, Column]] = cycle_123, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per document.

    ``copies`` lists (epoch, taken, position) of every copy that takes words.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = streams(docs.select("doc_id", source_key(F.col("source")).alias("source_key"), n_words().alias("size"), key.alias("order_key")), ["order_key", "size"], schedule, max_epochs)
    rows = budgeted(rows, max_epochs)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["taken"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def whole_copies(rows: DataFrame, max_epochs: int) -> DataFrame:
    """row, copies: ``rows`` of ``streams`` with (epoch, position) of every copy, all of them whole.

    Every document is taken as often as its source fits into the budget as a
    whole, and those at the beginning of the stream once more.  The gap before
    the first that does not fit is filled with later ones, longest first; one
    more follows if that leaves the source nearer its target, or if nothing of
    the source was taken.  All that decides is the number of later documents of
    each size; a filling document is found by its rank among those of its size.
    """
    budget = F.round("target").cast("long")
    rows = rows.where("size > 0").withColumn("times", F.least(F.lit(max_epochs), F.floor(budget / F.col("source_size")).cast("int")))
    rows = rows.withColumn("room", budget - F.col("times") * F.col("source_size")).withColumn("fits", F.col("before") + F.col("size") <= F.col("room"))
    rows = stage(rows, "streams")
    inside = F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))
    gaps = rows.groupBy("source_key").agg((F.first("room") - inside).alias("gap"), (inside + F.first("times") == 0).alias("nothing"))
    later = rows.where("not fits and times < %d" % max_epochs)
    counts = later.groupBy("source_key", "size").agg(F.count("*").alias("n")).join(stage(gaps, "gaps"), "source_key")
    over = F.min(F.when(F.col("size") > F.col("gap"), F.col("size"))).over(Window.partitionBy("source_key"))
    counts = counts.withColumn("over", over).where("size <= gap or size = over")
    per = counts.groupBy("source_key").agg(F.first("gap").alias("gap"), F.first("nothing").alias("nothing"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    # Fold over the sizes: ``left`` of the gap, ``picks`` (documents ``first`` to ``first + n - 1`` of a size, from the word ``at`` of the gap on), ``spare``: the least size that is not used up.
    walked = F.expr("""aggregate(sizes,
      named_struct('left', gap, 'picks', cast(array() as array<struct<size: bigint, first: bigint, n: bigint, at: bigint>>), 'spare', cast(null as struct<size: bigint, first: bigint>)),
      (acc, s) -> named_struct(
        'left', acc.left - least(s.n, acc.left div s.size) * s.size,
        'picks', if(acc.left >= s.size, concat(acc.picks, array(named_struct('size', s.size, 'first', 0L, 'n', least(s.n, acc.left div s.size), 'at', gap - acc.left))), acc.picks),
        'spare', if(s.n > acc.left div s.size, named_struct('size', s.size, 'first', acc.left div s.size), acc.spare)))""")
    one_more = "walked.spare is not null and (walked.spare.size < 2 * walked.left or (nothing and size(walked.picks) = 0))"
    last = "array(named_struct('size', walked.spare.size, 'first', walked.spare.first, 'n', 1L, 'at', gap - walked.left))"
    picks = per.withColumn("walked", walked).selectExpr("source_key", f"inline(if({one_more}, concat(walked.picks, {last}), walked.picks))")
    picks = stage(picks.join(gaps, "source_key"), "picks")
    used = later.select("row", "source_key", "size", "order_key").join(picks.select("source_key", "size").distinct(), ["source_key", "size"], "left_semi")
    used = with_prefix(used.withColumn("one", F.lit(1)), ["source_key", "size"], F.substring("order_key", 1, 3), ["order_key", "row"], "one", "rank")
    used = used.join(picks, ["source_key", "size"]).where("rank >= first and rank < first + n").select("row", (F.col("at") - F.col("gap") + (F.col("rank") - F.col("first")) * F.col("size")).alias("late"))
    rows = rows.join(used, "row", "left")

    def copy(e: Column, start: Column) -> Column:
        return F.struct(e.alias("epoch"), moment(start / F.col("target"), F.col("w0"), F.col("w1")).alias("position"))

    extra = F.when(F.col("fits"), F.col("before") + F.col("times") * F.col("source_size")).otherwise(budget + F.col("late"))
    whole = F.transform(F.filter(F.array(*[F.lit(e) for e in range(max_epochs)]), lambda e: e < F.col("times")), lambda e: copy(e, F.col("before") + e * F.col("source_size")))
    return rows.select("row", F.when(extra.isNull(), whole).otherwise(F.concat(whole, F.array(copy(F.col("times"), extra)))).alias("copies"))


def curriculum(docs: DataFrame, schedule: Callable[[Column], tuple[Column, Column]] = cycle_123, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every copy of every document in training order.

    Keeps the columns of ``docs``, and texts as they are.  Rows are numbered
    first, so that each meets only its own copies, whatever ids are null or
    repeated; a null id is ordered by a hash of the text, so that such rows
    spread too, and the rows of a repeated id follow each other.
    """
    row, key, copy = unused(docs, "row", "key", "copy")
    by_text = F.md5(F.coalesce("text", F.lit("")))
    order = F.concat(F.coalesce(F.md5(F.col("doc_id").cast("string")), by_text), by_text)
    numbered = stage(docs.select("*", F.monotonically_increasing_id().alias(row), order.alias(key)), "numbered", compression="zstd")
    sizes = numbered.select(F.col(row).alias("row"), source_key(F.col("source")).alias("source_key"), n_words().alias("size"), F.col(key).alias("order_key"))
    with only_last_table_stays(docs.sparkSession):
        plan = stage(whole_copies(streams(sizes, ["order_key", "size", "row"], schedule, max_epochs), max_epochs), "plan")
    plan = plan.select(F.col("row").alias(row), F.explode("copies").alias(copy))
    return numbered.join(plan, row).orderBy(f"{copy}.position", key, row, f"{copy}.epoch").select(*docs.columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document, in the order of first reading."""
    rows = allocate(docs).withColumn("first_position", F.get("copies", F.lit(0))["position"])
    return rows.orderBy("first_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_position")
