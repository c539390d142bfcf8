"""Chat formatting from event logs.

A log holds events of a conversation in sequence: ``message`` (a whole turn),
``delta`` (a streamed piece appended to its turn), ``edit`` (replaces the text
of its turn) and ``regenerate`` (starts its turn anew and voids all that later
turns had received before).  Logs are partitioned by conversation, sorted by
sequence and folded into final messages, which are then rendered.  Everything
after the one shuffle by conversation uses the same partitioning, and only
DataFrame functions are used.

A rendered turn is ``<s>`` role newline text ``</s>`` newline.  Inside roles
and texts, backslash, ``<`` and ``[`` are written as backslash and ``s``, ``l``
or ``b`` (in roles newline as backslash and ``n``), so no control string of this
or of bracket templates survives in them, and ``unescape`` restores them.  The loss mask lists one span per assistant
turn: turn number, and start and end inside that turn's rendering and inside
the whole, in code points.

Defined results: null text or role is empty; null kind is ``message``; events
without conversation belong to one conversation with null id; equal sequence
numbers are ordered by turn, kind and text; repeated rows are separate events;
texts of any length stay whole; other columns, whatever their names, are not
read; an empty log gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("\n", "\\n"))


def escape(text: Column, line: bool = False) -> Column:
    """``line``: newlines too, for what must stay on one line."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES[: 3 + line], text)


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text begins an escape, so these are undone one by one, backslash last."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of the event log (conv_id, seq, kind, turn, role, text)."""
    log = events.select(
        "conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("turn"), F.desc("kind"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    voided = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later) < F.col("turn")
    log = log.withColumn("void", F.coalesce(voided, F.lit(False))).where("not void")
    follow = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "text").rowsBetween(1, Window.unboundedFollowing)
    log = log.withColumn("stale", F.count(F.when(F.col("kind") != "delta", 1)).over(follow) > 0).where("not stale")
    pieces = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    return log.groupBy("conv_id", "turn").agg(
        F.min_by("role", F.struct("seq", "kind", "text")).alias("role"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of final messages; loss is the list of mask spans."""
    head, body = F.concat(F.lit(OPEN), escape(F.col("role"), line=True), F.lit("\n")), escape(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = messages.withColumn("part", F.concat(head, body, F.lit(CLOSE))).withColumn("head", F.length(head)).withColumn("body", F.length(body))
    turns = turns.withColumn("pos", F.row_number().over(order) - 1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("part").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begin, end = F.col("head"), F.col("head") + F.col("body")
    span = F.struct(F.col("pos").alias("turn"), begin.alias("turn_start"), end.alias("turn_end"), (F.col("at") + begin).alias("start"), (F.col("at") + end).alias("end"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "part")))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) recovered from the rendered text and its mask alone."""
    raw = F.split("formatted", CLOSE)
    parsed = rendered.withColumn("raw", F.slice(raw, 1, F.size(raw) - 1))

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        return F.struct(unescape(role.substr(F.lit(len(OPEN) + 1), F.length(role))).alias("role"), unescape(t.substr(F.length(role) + 2, F.length(t))).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.get("raw", s["turn"]).substr(s["turn_start"] + 1, s["turn_end"] - s["turn_start"])))
    return parsed.select("conv_id", F.transform("raw", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered conversations of a table of finished turns (conv_id, turn, role, text): each row is one message."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).alias("turn"), "role", "text")
    return render(fold(rows.withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))))
