"""Live counts: points of a stream joined with fences, counted per fence and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracover.operators.joins import pip_join


def fence_counts(points: DataFrame, edges: DataFrame, window: str = "10 minutes", slide: str | None = None, lateness: str = "30 minutes") -> DataFrame:
    """(fid, window_start, n): points (id, lat, lon, ts) inside fences per event-time window.

    Works on a stream or a table. The fences are static; late points are taken up to `lateness`.
    """
    seen = points.withWatermark("ts", lateness)
    inside = pip_join(seen, edges, ["id", "ts"])
    counts = inside.groupBy("fid", F.window("ts", window, slide)).agg(F.count("*").alias("n"))
    return counts.select("fid", F.col("window.start").alias("window_start"), "n")


def first_seen(points: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream without repeats of an id within the watermark."""
    return points.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])
