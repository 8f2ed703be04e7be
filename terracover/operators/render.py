"""Rendering features (fid, name, parts: rings, polys: polygons of rings) in every return type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.operators import formats


def parts_of(polygons: DataFrame, fences: DataFrame) -> DataFrame:
    """(fid, name, parts, polys): all rings of each fence in order, and the same by polygon."""
    own = formats.nested(polygons).withColumn("parts", F.flatten("polys"))
    return own.join(fences.select("fid", "name"), "fid").select("fid", "name", "parts", "polys")


def _flip(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def coerced(parts: Column, geo_type: str, polys: Column | None = None) -> Column:
    """GeoJSON coordinates as Point, MultiPoint, Polygon or MultiPolygon.

    A Polygon takes all rings, of several polygons too; a MultiPolygon keeps its polygons and their holes where
    these are given (polys), else every ring becomes a polygon.
    """
    if geo_type == "Point":
        return _flip(F.element_at(F.flatten(parts), 1))
    if geo_type == "MultiPoint":
        return F.transform(F.flatten(parts), _flip)
    ring = lambda r: F.transform(r, _flip)
    if geo_type == "Polygon":
        return F.transform(parts, ring)
    return F.transform(parts, lambda r: F.array(ring(r))) if polys is None else F.transform(polys, lambda p: F.transform(p, ring))


def rendered(features: DataFrame, form: str) -> DataFrame:
    """(fid, out): each feature in a return type, as text."""
    parts, one = F.col("parts"), F.flatten("parts")
    pair = lambda p: F.array(p["lat"], p["lon"])
    single, several = coerced(parts, "Polygon"), coerced(parts, "MultiPolygon", F.col("polys"))
    by_parts = lambda make: F.when(F.size("polys") == 1, make("Polygon", single)).otherwise(make("MultiPolygon", several))
    geometry = by_parts(lambda kind, at: F.to_json(formats.geometry_of(kind, at)))
    feature = by_parts(lambda kind, at: formats.collection(kind, F.col("fid"), F.col("name"), at))
    by = {
        "text": formats.to_text(one, ",", "\n"),
        "alt_text": formats.to_text(one, " ", ","),
        "single_array": F.to_json(F.transform(one, pair)),
        "multi_array": F.to_json(F.transform(parts, lambda r: F.transform(r, pair))),
        "single_struct": F.to_json(one),
        "multi_struct": F.to_json(parts),
        "geometry": geometry,
        "geometry_vec": F.concat(F.lit("["), geometry, F.lit("]")),
        "feature": feature,
        "feature_vec": F.concat(F.lit("["), feature, F.lit("]")),
        "feature_collection": F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")),
        "poracle": F.to_json(F.array(F.struct((F.col("fid") + 1).alias("id"), "name", F.transform(one, pair).alias("path")))),
        "poracle_single": F.to_json(F.struct((F.col("fid") + 1).alias("id"), "name", F.transform(one, pair).alias("path"))),
    }
    if form not in by:
        raise ValueError(f"no such return type: {form}")
    return features.select("fid", by[form].alias("out"))
