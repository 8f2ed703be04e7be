"""Edits of a selection: cutouts, splits, links, per-selection statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracover.functions import geo
from terracover.operators.formats import with_part
from terracover.operators.joins import in_any_fence
from terracover.operators.polygons import intersecting


def filter_points(points: DataFrame, edges: DataFrame, keep_inside: bool) -> DataFrame:
    """The points inside any fence, or those (and the points without a place) that are in none."""
    return in_any_fence(points, edges, inside=keep_inside)


def cutouts(edges: DataFrame) -> DataFrame:
    """The holes of all parts as polygons of their own."""
    return edges.where("ring > 0").select("fid", *(["part"] if "part" in edges.columns else []), "ring", "seq", "ex1", "ey1", "ex2", "ey2")


def split_parts(edges: DataFrame, fences: DataFrame) -> DataFrame:
    """Each part of a fence as a fence: (name, fid, ring, seq, sides), named after the fence and the number of the part."""
    own = with_part(edges).join(fences.select("fid", "name"), "fid")
    return own.select(F.concat_ws("__", "name", F.col("part").cast("string")).alias("name"), "fid", "ring", "seq", "ex1", "ey1", "ex2", "ey2")


def split_lines(stops: DataFrame, key: str) -> DataFrame:
    """The stops and the planar midpoint of every leg, in order (seq doubles)."""
    w = Window.partitionBy(key).orderBy("seq")
    legs = stops.select(key, "seq", "lat", "lon", F.lead("lat").over(w).alias("y"), F.lead("lon").over(w).alias("x"))
    lat, lon = geo.midpoint(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    mids = legs.where("y is not null").select(key, (F.col("seq") * 2 + 1).alias("seq"), lat.alias("lat"), lon.alias("lon"))
    return stops.select(key, (F.col("seq") * 2).alias("seq"), "lat", "lon").unionByName(mids)


def links(stops: DataFrame, key: str) -> DataFrame:
    """Each stop with the seq of the one before and after it, wrapping around."""
    w = Window.partitionBy(key).orderBy("seq")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return stops.select(key, "seq", F.coalesce(F.lead("seq").over(w), F.first("seq").over(full)).alias("forward"), F.coalesce(F.lag("seq").over(w), F.last("seq").over(full)).alias("backward"))


def leg_colours(stops: DataFrame, key: str) -> DataFrame:
    """(key, colour, legs): legs per length bucket, in metres."""
    w = Window.partitionBy(key).orderBy("seq")
    d = geo.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    colour = F.when(F.col("d") <= 500, "green").when(F.col("d") <= 1000, "yellow").when(F.col("d") <= 1500, "orange").otherwise("red")
    return stops.select(key, d.alias("d")).where("d is not null").groupBy(key, colour.alias("colour")).agg(F.count("*").alias("legs"))


def filter_polygons(selected: DataFrame, shapes: DataFrame, keep_inside: bool = True) -> DataFrame:
    """The sides of the shapes that share area with a selected fence other than themselves, or of those that do not; the selected stay."""
    hit = intersecting(selected, shapes).where("a <> b").select(F.col("b").alias("fid")).distinct()
    own = selected.select("fid").distinct()
    if keep_inside:
        return shapes.join(hit.unionByName(own).distinct(), "fid", "left_semi")
    return shapes.join(hit.join(own, "fid", "left_anti"), "fid", "left_anti")
