"""Readers of area documents: GeoJSON, text, flat fence records, shapefiles; and the writer of results."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracover.functions.s2 import inside
from terracover.operators.formats import to_features

FEATURES = "path string, seq long, name string, geometry string, properties string"
EDGES = "fid long, part int, ring int, seq int, ex1 double, ey1 double, ex2 double, ey2 double"


def _rows(path: str, features: list[dict]) -> list[tuple]:
    return [(path, k, (f.get("properties") or {}).get("name"), json.dumps(f.get("geometry")), json.dumps(f.get("properties") or {})) for k, f in enumerate(features)]


def parse_areas(docs: DataFrame) -> DataFrame:
    """Features of documents (path, text) in any input form; text that is no JSON is a text area."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, text in zip(b["path"], b["text"], strict=True):
                try:
                    doc = json.loads(text)
                except ValueError:
                    doc = text
                rows += _rows(p, to_features(doc))
            yield pd.DataFrame(rows, columns=["path", "seq", "name", "geometry", "properties"])

    return docs.select("path", "text").where("text is not null").mapInPandas(run, FEATURES)


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Features of files in any input form, one document a file."""
    return parse_areas(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def _of_rings(rings: list[list[list[float]]]) -> dict:
    """A shapefile's polygon: clockwise rings are outlines, the others holes of the outline around them; without any clockwise ring the first is the outline."""
    turn = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) for r in rings]
    outlines = [k for k, t in enumerate(turn) if t < 0]
    if len(outlines) < 2:
        first = outlines or [0]
        return {"type": "Polygon", "coordinates": [rings[k] for k in first if rings] + [r for k, r in enumerate(rings) if k not in first]}
    parts = {k: [rings[k]] for k in outlines}
    for k, r in enumerate(rings):
        if k not in parts:
            around = [o for o in outlines if inside(np.array([r[0][::-1]]), np.array(rings[o])[:, ::-1])[0]]
            parts[max(around, key=lambda o: turn[o]) if around else max((o for o in outlines if o < k), default=outlines[0])].append(r)
    return {"type": "MultiPolygon", "coordinates": list(parts.values())}


def shapes(data: bytes) -> list[dict]:
    """Features of a .shp file: points, multipoints, lines and polygons (types 1, 8, 3, 5 and their Z, M kinds)."""
    out, at = [], 100
    while at + 12 <= len(data):
        _, words = struct.unpack_from(">ii", data, at)
        kind = struct.unpack_from("<i", data, at + 8)[0] % 10
        body = at + 12
        geometry = None
        if kind == 1:
            geometry = {"type": "Point", "coordinates": list(struct.unpack_from("<dd", data, body))}
        elif kind == 8:
            n = struct.unpack_from("<i", data, body + 32)[0]
            geometry = {"type": "MultiPoint", "coordinates": [list(struct.unpack_from("<dd", data, body + 36 + 16 * i)) for i in range(n)]}
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<ii", data, body + 32)
            cuts = [*struct.unpack_from(f"<{parts}i", data, body + 40), n]
            points = [list(struct.unpack_from("<dd", data, body + 40 + 4 * parts + 16 * i)) for i in range(n)]
            rings = [points[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            geometry = {"type": "MultiLineString", "coordinates": rings} if kind == 3 else _of_rings(rings)
        if geometry:
            out.append({"type": "Feature", "geometry": geometry, "properties": {}})
        at += 8 + 2 * words
    return out


def parse_shapefiles(files: DataFrame) -> DataFrame:
    """Features of shapefiles that are there as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b["path"], b["content"], strict=True) for r in _rows(p, shapes(bytes(c)))], columns=["path", "seq", "name", "geometry", "properties"])

    return files.select("path", "content").mapInPandas(run, FEATURES)


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """Features of the .shp files below a path."""
    return parse_shapefiles(spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path))


def _polygons(geometry: object) -> list:
    """The polygons of a decoded geometry, those of collections (in collections) in their order; others have none."""
    found, todo = [], [geometry]
    while todo:
        g = todo.pop()
        if not isinstance(g, dict):
            continue
        if g.get("type") == "GeometryCollection":
            todo += reversed(g.get("geometries") or [])
        elif g.get("type") in ("Polygon", "MultiPolygon") and g.get("coordinates"):
            found += [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
    return found


def _flattened(geometries: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(_polygons(json.loads(g))) for g in geometries], dtype=object)


def parts_of(features: DataFrame, key: str = "seq") -> DataFrame:
    """(fid, part, ring, points): the rings of Polygon, MultiPolygon and GeometryCollection features (fid = key).

    A part is one polygon, ring 0 its outline and the others its holes. The parts of a collection are
    those of all its polygons, of collections inside it too; geometries without area are passed over.
    """
    rows = features.select(F.col(key).cast("long").alias("fid"), F.get_json_object("geometry", "$.type").alias("kind"), "geometry")
    at = F.get_json_object("geometry", "$.coordinates")
    parts = "array<array<array<array<double>>>>"
    flat = F.when(F.col("kind") == "Polygon", F.array(F.from_json(at, "array<array<array<double>>>"))).when(F.col("kind") == "MultiPolygon", F.from_json(at, parts))
    plain = rows.where("kind in ('Polygon', 'MultiPolygon')").select("fid", flat.alias("parts"))
    _flattened.__annotations__ = {"geometries": pd.Series, "return": pd.Series}
    nested = rows.where("kind = 'GeometryCollection'").select("fid", F.from_json(F.pandas_udf(_flattened, "string")("geometry"), parts).alias("parts"))
    one = plain.unionByName(nested).select("fid", F.posexplode("parts").alias("part", "rings"))
    return one.select("fid", "part", F.posexplode("rings").alias("ring", "points"))


def edges_of(features: DataFrame, key: str = "seq") -> DataFrame:
    """The edge table of features with area (fid = key): part, ring in the part, and sides in order; see parts_of."""
    one = parts_of(features, key).withColumnRenamed("points", "p")
    legs = one.select("fid", "part", "ring", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k")).withColumn("q", F.when(F.col("k") < F.size("p"), F.expr("p[k]")).otherwise(F.expr("p[0]")))
    out = legs.select("fid", "part", "ring", (F.col("k") - 1).alias("seq"), F.expr("p[k - 1][0]").alias("ex1"), F.expr("p[k - 1][1]").alias("ey1"), F.expr("q[0]").alias("ex2"), F.expr("q[1]").alias("ey2"))
    return out.where("ex1 <> ex2 or ey1 <> ey2")


def write_result(result: DataFrame, path: str, form: str = "parquet", benchmark: bool = False) -> None:
    """Writes a result as parquet, json, csv or text (one string column); benchmark mode drops the data."""
    result.write.mode("overwrite").format("noop" if benchmark else form).save(*([] if benchmark else [path]))
