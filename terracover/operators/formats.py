"""Parsing and rendering geometries between text, arrays, GeoJSON, flat fence records and SQL."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracover.operators.grouping import numbered

POINTS = "array<struct<lat:double,lon:double>>"


def parse_text(text: Column) -> Column:
    """Points of `lat,lon` lines or of `lat lon,lat lon`; bad tokens are skipped, the ring is closed.

    The second form is told by its first token, up to a comma, holding a blank.
    """
    alt = F.trim(F.split_part(text, F.lit(","), F.lit(1))).contains(" ")
    pairs = F.when(alt, F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), r"\s+"))).otherwise(F.transform(F.split(text, r"\r?\n"), lambda p: F.split(p, ",")))
    number = lambda p, k: F.trim(F.get(p, F.lit(k))).try_cast("double")
    points = F.transform(pairs, lambda p: F.struct(number(p, 0).alias("lat"), number(p, 1).alias("lon")))
    return closed(F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()))


def closed(points: Column) -> Column:
    """The ring with its first point at the end, unless it is there."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(F.size(points) == 0, points).otherwise(F.when(first == last, points).otherwise(F.concat(points, F.array(first))))


def closed_geojson(points: Column) -> Column:
    """The GeoJSON variant: appends only where both coordinates differ."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when((F.size(points) > 0) & (first["lat"] != last["lat"]) & (first["lon"] != last["lon"]), F.concat(points, F.array(first))).otherwise(points)


def to_text(points: Column, inner: str = ",", outer: str = "\n", places: int = 6) -> Column:
    fixed = lambda c: F.format_string(f"%.{places}f", c)
    return F.array_join(F.transform(points, lambda p: F.concat(fixed(p["lat"]), F.lit(inner), fixed(p["lon"]))), outer)


def trim_precision(points: Column, places: int = 6) -> Column:
    """Half away from zero."""
    return F.transform(points, lambda p: F.struct(F.round(p["lat"], places).alias("lat"), F.round(p["lon"], places).alias("lon")))


def with_part(edges: DataFrame) -> DataFrame:
    """An edge table with the number of the polygon that a ring belongs to; without one, all rings are of one polygon."""
    return edges if "part" in edges.columns else edges.withColumn("part", F.lit(0))


def rings(edges: DataFrame) -> DataFrame:
    """(fid, part, ring, points): closed rings of an edge table."""
    own = with_part(edges).groupBy("fid", "part", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("ey1").alias("lat"), F.col("ex1").alias("lon")))).alias("p"))
    return own.select("fid", "part", "ring", closed(F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))).alias("points"))


def nested(polygons: DataFrame, ring: Column | str = "points") -> DataFrame:
    """(fid, polys): each fence's polygons in order, each an array of its rings, the outline first."""
    own = polygons.select("fid", "part", "ring", F.col(ring).alias("r") if isinstance(ring, str) else ring.alias("r"))
    parts = own.groupBy("fid", "part").agg(F.sort_array(F.collect_list(F.struct("ring", "r"))).alias("rs"))
    return parts.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("part", "rs"))).alias("ps")).select("fid", F.transform("ps", lambda p: F.transform(p["rs"], lambda r: r["r"])).alias("polys"))


def exploded(edges: DataFrame) -> DataFrame:
    """(fid, part, rings): each polygon of each fence as a feature of its own, its rings with the outline first."""
    return nested(rings(edges)).select("fid", F.posexplode("polys").alias("part", "rings"))


def sql_contains(polygons: DataFrame) -> DataFrame:
    """(fid, sql): an ST_CONTAINS condition per fence, on a Polygon or, of several parts, a MultiPolygon."""
    fixed = lambda c: F.format_string("%.6f", c)
    listed = lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
    ring = listed(F.transform("points", lambda p: F.concat(F.lit("["), fixed(p["lon"]), F.lit(","), fixed(p["lat"]), F.lit("]"))))
    own = nested(polygons, ring).select("fid", F.size("polys").alias("n"), F.transform("polys", listed).alias("polys"))
    body = F.when(F.col("n") == 1, F.concat(F.lit('Polygon","coordinates":'), F.get("polys", F.lit(0)))).otherwise(F.concat(F.lit('MultiPolygon","coordinates":'), listed(F.col("polys"))))
    return own.select("fid", F.concat(F.lit("ST_CONTAINS(ST_GeomFromGeoJSON('{\"type\":\""), body, F.lit("}', 2, 0), POINT(lon, lat))")).alias("sql"))


def deduplicated(points: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Points without later repeats of a position within a key."""
    w = Window.partitionBy(key, "lat", "lon").orderBy(seq)
    return points.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def poracle(fences: DataFrame, polygons: DataFrame, groups: DataFrame) -> DataFrame:
    """Flat fence records: id from 1 by name, group, flags, path of the outer ring or multipath of several."""
    paths = polygons.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("part", "ring", F.transform("points", lambda p: F.array(F.round(p["lat"], 6), F.round(p["lon"], 6))).alias("p")))).alias("rs"))
    both = numbered(fences.select("fid", "name", "parent"), "name", "id").join(paths, "fid").join(groups, "parent", "left")
    one = F.size("rs") == 1
    all_ = F.transform("rs", lambda r: r["p"])
    return both.select(
        (F.col("id") + 1).alias("id"), "name", F.coalesce("group", F.lit("")).alias("group"), F.lit(True).alias("userSelectable"), F.lit(True).alias("displayInMatches"),
        F.when(one, F.element_at(all_, 1)).alias("path"), F.when(~one, all_).alias("multipath"),
    )


def geometry_of(geo_type: str, coordinates: Column) -> Column:
    return F.struct(F.lit(geo_type).alias("type"), coordinates.alias("coordinates"))


def collection(geo_type: str, fid: Column, name: Column, coordinates: Column) -> Column:
    """A Feature's JSON text."""
    geometry = geometry_of(geo_type, coordinates)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), fid.alias("id"), geometry.alias("geometry"), F.struct(name.alias("name")).alias("properties")))


def simplified(points: Column, epsilon: float = 1e-4) -> Column:
    """Ramer-Douglas-Peucker on each ring, in degrees."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([_rdp([(p["lat"], p["lon"]) for p in r], epsilon) if r is not None else None for r in rows], dtype=object)

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<array<double>>")(points)


def _rdp(points: list[tuple[float, float]], epsilon: float) -> list[list[float]]:
    p = np.array(points).reshape(-1, 2)
    keep = np.zeros(len(p), bool)
    if len(p):
        keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = p[b] - p[a], p[a + 1 : b] - p[a]
        far = np.hypot(*v.T) if not d.any() else np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / np.hypot(*d)
        k = int(np.argmax(far))
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep].tolist()


#: Input forms in the order in which they are tried.
FORMS = ("text", "single_array", "multi_array", "single_struct", "multi_struct", "geometry", "geometry_vec", "feature", "feature_vec", "feature_collection", "poracle_vec", "poracle", "bound")
_GEOMETRIES = {"Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"}


def sniff(doc: object) -> str:
    """The form of one decoded JSON document, for API-style calls."""
    if isinstance(doc, str):
        return "text"
    if isinstance(doc, dict):
        kind = doc.get("type")
        if kind in _GEOMETRIES:
            return "geometry"
        if kind in ("Feature", "FeatureCollection"):
            return "feature" if kind == "Feature" else "feature_collection"
        return "bound" if {"min_lat", "min_lon", "max_lat", "max_lon"} <= doc.keys() else "poracle"
    if isinstance(doc, list) and doc:
        x = doc[0]
        if isinstance(x, dict):
            if {"lat", "lon"} <= x.keys():
                return "single_struct"
            return "geometry_vec" if x.get("type") in _GEOMETRIES else "feature_vec" if x.get("type") == "Feature" else "poracle_vec"
        if isinstance(x, list) and x:
            return "single_array" if isinstance(x[0], (int, float)) else "multi_struct" if isinstance(x[0], dict) else "multi_array"
    return "single_array"


def to_features(doc: object) -> list[dict]:
    """The canonical features of one document; rings are closed, array and text inputs are one polygon per part."""
    form = sniff(doc)
    ring = lambda pts: pts if not pts or pts[0] == pts[-1] else [*pts, pts[0]]
    polygon = lambda parts: {"type": "Feature", "geometry": {"type": "MultiPolygon" if len(parts) > 1 else "Polygon", "coordinates": [[ring(p)] for p in parts] if len(parts) > 1 else [ring(parts[0])] if parts else []}, "properties": {}}
    flip = lambda pts: [[p["lon"], p["lat"]] if isinstance(p, dict) else [p[1], p[0]] for p in pts]
    if form == "text":
        if doc.lstrip().startswith("{"):
            return to_features(json.loads(doc))
        return [polygon([flip(_text_points(doc))])]
    if form in ("single_array", "single_struct"):
        return [polygon([flip(doc)])] if doc else []
    if form in ("multi_array", "multi_struct"):
        return [polygon([flip(p) for p in doc])]
    if form == "geometry":
        return [{"type": "Feature", "geometry": doc, "properties": {}}]
    if form == "geometry_vec":
        return [f for g in doc for f in to_features(g)]
    if form == "feature":
        return [doc]
    if form == "feature_vec":
        return list(doc)
    if form == "feature_collection":
        return list(doc["features"])
    if form == "bound":
        y0, x0, y1, x1 = (doc[k] for k in ("min_lat", "min_lon", "max_lat", "max_lon"))
        return [polygon([[[x0, y0], [x1, y0], [x1, y1], [x0, y1]]])]
    out = []
    for r in doc if isinstance(doc, list) else [doc]:
        f = polygon([flip(p) for p in r.get("multipath") or [r.get("path") or []]])
        f["properties"] = {k: v for k, v in r.items() if k not in ("path", "multipath") and v is not None}
        out.append(f)
    return out


def _text_points(text: str) -> list[list[float]]:
    alt = " " in text.split(",", 1)[0].strip()
    out = []
    for token in text.split(",") if alt else text.splitlines():
        try:
            a, b = (token.split() if alt else token.split(","))[:2]
            out.append([float(a), float(b)])
        except ValueError:
            continue
    return out


#: Names of return types and what they mean; hyphens and case do not matter.
RETURN_TYPES = {"text": "text", "alttext": "alt_text", "singlearray": "single_array", "multiarray": "multi_array", "singlestruct": "single_struct", "multistruct": "multi_struct", "geometry": "geometry", "geometryvec": "geometry_vec", "feature": "feature", "featurevec": "feature_vec", "featurecollection": "feature_collection", "poracle": "poracle", "poraclesingle": "poracle_single", "sql": "sql"}


def return_type(name: str, default: str) -> str:
    """The return type of a name; `array` and `struct` are single or multi as the default is."""
    plain = name.lower().replace("-", "").replace("_", "")
    if plain in ("array", "struct"):
        return f"{'multi' if default.startswith('multi') else 'single'}_{plain}"
    return RETURN_TYPES.get(plain, default)
