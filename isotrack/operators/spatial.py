"""Exact crossings of track segments with polygon edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_crossings(segs: DataFrame, edges: DataFrame, width: float = 5.0) -> DataFrame:
    """Where segments enter land: sid, event_id, f (part of the segment), lat, lon, and the edge.

    segs: (sid, event_id, lat, lon, lat2, lon2); edges: (edge_id, x1, y1, x2, y2) with land on their left.  Both
    are filed under the boxes of ``width`` degrees that their bounding boxes touch, so a segment meets only near
    edges.  A crossing at an edge's first end counts, at its last end not, so a corner counts once.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / width), F.floor(F.greatest(a, b) / width)))
    s = segs.withColumn("bx", span("lon", "lon2")).withColumn("by", span("lat", "lat2"))
    e = edges.withColumn("bx", span("x1", "x2")).withColumn("by", span("y1", "y2"))
    near = s.join(e, ["bx", "by"]).dropDuplicates(["sid", "event_id", "edge_id"])
    dx, dy, ex, ey = F.col("lon2") - F.col("lon"), F.col("lat2") - F.col("lat"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = dx * ey - dy * ex  # positive: from the right of the edge to its left
    ox, oy = F.col("x1") - F.col("lon"), F.col("y1") - F.col("lat")
    found = near.withColumns({"turn": turn, "f": F.try_divide(ox * ey - oy * ex, turn), "g": F.try_divide(ox * dy - oy * dx, turn)})
    found = found.where("turn < 0 AND f >= 0 AND f <= 1 AND g >= 0 AND g < 1")
    return found.select("sid", "event_id", "edge_id", "f", (F.col("lat") + F.col("f") * dy).alias("lat"), (F.col("lon") + F.col("f") * dx).alias("lon"))


def first_entries(crossings: DataFrame) -> DataFrame:
    """The first entry of every segment; entries within 1e-8 of one place are one."""
    places = crossings.withColumn("place", F.round("f", 8)).dropDuplicates(["sid", "event_id", "place"])
    return places.withColumn("r", F.row_number().over(Window.partitionBy("sid", "event_id").orderBy("place", "edge_id"))).where("r = 1").drop("r", "place")
