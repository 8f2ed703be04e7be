"""Queries over fences of several polygons: MultiPolygons and collections, read, measured, edited and rendered."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from terracover.operators import bootstrap, client, formats, polygons, render, stats
from terracover.operators.joins import edge_distances, pip_join
from terracover.plans.registry import Views, query
from terracover.sources import readers

SIDES = "count(*) AS edges, round(sum(ex1), 5) AS x, round(sum(ey1), 5) AS y, round(sum(ex1*ey2 - ex2*ey1)*1000000, 2) AS area"
BY_RING = f"SELECT fid, CAST(part AS INT) AS part, CAST(ring AS INT) AS ring, {SIDES} FROM part_edge GROUP BY fid, part, ring"


def _by_ring(edges):
    """Sides of each ring with the sums of their coordinates and twice its area."""
    area = F.col("ex1") * F.col("ey2") - F.col("ex2") * F.col("ey1")
    return edges.groupBy("fid", F.col("part").cast("int").alias("part"), F.col("ring").cast("int").alias("ring")).agg(
        F.count("*").alias("edges"), F.round(F.sum("ex1"), 5).alias("x"), F.round(F.sum("ey1"), 5).alias("y"), F.round(F.sum(area) * 1000000, 2).alias("area")
    )


def _features(v: Views):
    return render.parts_of(formats.rings(v.part_edge), v.fence)


def _read_again(docs):
    return _by_ring(readers.edges_of(readers.parse_areas(docs), "path"))


@query("part_edge", BY_RING)
def q_parts_geojson(v: Views):
    """Written as Polygon and MultiPolygon features and read again: each ring in its place in its part."""
    docs = render.rendered(_features(v), "feature_collection")
    return _read_again(docs.select(F.col("fid").cast("string").alias("path"), F.col("out").alias("text")))


@query("part_edge", BY_RING)
def q_parts_collection(v: Views):
    """Each polygon a member of a GeometryCollection, the last in a collection of its own, between points and lines."""
    one = F.transform("polys", lambda p: F.to_json(formats.geometry_of("Polygon", F.transform(p, lambda r: F.transform(r, lambda x: F.array(x["lon"], x["lat"]))))))
    first, last = F.array_join(F.slice(one, 1, F.size("polys") - 1), ","), F.element_at(one, -1)
    point, line = '{"type":"Point","coordinates":[1,2]}', '{"type":"LineString","coordinates":[[1,2],[3,4]]}'
    before = F.when(F.size("polys") > 1, F.concat(first, F.lit(","))).otherwise("")
    text = F.concat(F.lit(f'{{"type":"GeometryCollection","geometries":[{point},'), before, F.lit(f'{line},{{"type":"GeometryCollection","geometries":['), last, F.lit(f",{point}]}}]}}"))
    return _read_again(_features(v).select(F.col("fid").cast("string").alias("path"), text.alias("text")))


@query("part_edge", BY_RING)
def q_parts_shapefile(v: Views):
    """As the bytes of shapefiles, outlines clockwise and holes not; what is read is turned back."""

    def packed(batches):
        for b in batches:
            for name, polys in zip(b["path"], b["polys"], strict=True):
                rings = [[(p["lon"], p["lat"]) for p in r][:: -1 if k == 0 else 1] for poly in polys for k, r in enumerate(poly)]
                points = [p for r in rings for p in r]
                starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
                body = struct.pack("<i4dii", 5, *(f(p[c] for p in points) for f, c in ((min, 0), (min, 1), (max, 0), (max, 1))), len(rings), len(points))
                body += struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{2 * len(points)}d", *(c for p in points for c in p))
                yield pd.DataFrame({"path": [name], "content": [bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body]})

    files = _features(v).select(F.col("fid").cast("string").alias("path"), "polys").mapInPandas(packed, "path string, content binary")
    return _by_ring(readers.edges_of(readers.parse_shapefiles(files), "path")).withColumn("area", F.when(F.col("ring") == 0, -F.col("area")).otherwise(F.col("area")))


_SQUARE = "abs(radians(x1-x0)*(sin(radians(y1))-sin(radians(y0)))*6378137.0*6378137.0)"


@query("part_ring", f"SELECT fid, round(sum(CASE WHEN ring = 0 THEN {_SQUARE} ELSE -{_SQUARE} END), 0) AS area FROM part_ring GROUP BY fid")
def q_parts_area(v: Views):
    return stats.area(v.part_edge)


@query("part_edge", "SELECT fid, part, ring, seq, ex1, ey1, ex2, ey2 FROM part_edge WHERE ring > 0")
def q_parts_cutouts(v: Views):
    return client.cutouts(v.part_edge)


@query("fence part_edge", "SELECT f.name || '__' || CAST(part AS VARCHAR) AS name, count(*) AS edges, count(DISTINCT ring) AS rings FROM part_edge e JOIN fence f USING (fid) GROUP BY f.name, part")
def q_parts_split(v: Views):
    return client.split_parts(v.part_edge, v.fence).groupBy("name").agg(F.count("*").alias("edges"), F.countDistinct("ring").alias("rings"))


@query("part_ring", "SELECT fid, CAST(part AS INT) AS part, CAST(count(*) AS INT) AS rings, CAST(5 * count(*) AS INT) AS n, max(CASE WHEN ring = 0 THEN x1 END) AS east FROM part_ring GROUP BY fid, part")
def q_parts_explode(v: Views):
    """Each polygon with the number of its rings and points and its outline's east."""
    east = F.array_max(F.transform(F.get("rings", F.lit(0)), lambda p: p["lon"]))
    return formats.exploded(v.part_edge).select("fid", "part", F.size("rings").alias("rings"), F.size(F.flatten("rings")).alias("n"), east.alias("east"))


_BOX = "printf('[[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f]]', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)"
_PART = f"SELECT fid, part, '[' || string_agg({_BOX}, ',' ORDER BY ring) || ']' AS t FROM part_ring GROUP BY fid, part"


@query("part_ring", f"SELECT fid, 'ST_CONTAINS(ST_GeomFromGeoJSON(''{{\"type\":\"' || CASE WHEN count(*) = 1 THEN 'Polygon\",\"coordinates\":' || min(t) ELSE 'MultiPolygon\",\"coordinates\":[' || string_agg(t, ',' ORDER BY part) || ']' END || '}}'', 2, 0), POINT(lon, lat))' AS sql FROM ({_PART}) GROUP BY fid")
def q_parts_sql(v: Views):
    return formats.sql_contains(formats.rings(v.part_edge))


@query("part_ring", "SELECT fid, t AS geo_type, CAST(CASE t WHEN 'Point' THEN 2 WHEN 'MultiPoint' THEN 5 * count(*) WHEN 'Polygon' THEN count(*) ELSE count(DISTINCT part) END AS INT) AS n FROM part_ring, (VALUES ('Point'), ('MultiPoint'), ('Polygon'), ('MultiPolygon')) AS k(t) GROUP BY fid, t")
def q_parts_coerce(v: Views):
    """Sizes of the coordinates as each type: a MultiPolygon has a polygon for each part, holes inside."""
    one = _features(v)
    kinds = F.array(*(F.struct(F.lit(t).alias("geo_type"), F.size(render.coerced(F.col("parts"), t, F.col("polys"))).alias("n")) for t in ("Point", "MultiPoint", "Polygon", "MultiPolygon")))
    return one.select("fid", F.inline(kinds))


@query("spawnpoint part_edge", "SELECT p.id, e.fid FROM spawnpoint p JOIN part_edge e ON ((e.ey1 > p.lat) <> (e.ey2 > p.lat)) AND p.lon < (e.ex2-e.ex1)*(p.lat-e.ey1)/(e.ey2-e.ey1)+e.ex1 GROUP BY p.id, p.lat, p.lon, e.fid HAVING count(*) % 2 = 1")
def q_parts_pip(v: Views):
    return pip_join(v.spawnpoint, v.part_edge, ["id"])


@query("fence part_ring", "SELECT f.parent, count(*) AS rings, round(sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * (r.x1-r.x0)*(r.y1-r.y0)) * 1000000, 3) AS area FROM part_ring r JOIN fence f USING (fid) GROUP BY f.parent")
def q_parts_union(v: Views):
    """Union of the fences of each parent over all their parts: disjoint, so rings and areas add up."""
    rows = v.part_edge.join(v.fence.select("fid", "parent"), "fid").select("parent", "fid", "part", "ring", "seq", "ex1", "ey1")
    w = polygons.union_by(rows, "parent").groupBy("parent", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    n = F.size("p")
    term = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, k: a + F.get("p", k)["x"] * F.get("p", (k + 1) % n)["y"] - F.get("p", k)["y"] * F.get("p", (k + 1) % n)["x"])
    return w.select("parent", (term / 2).alias("a")).groupBy("parent").agg(F.count("*").alias("rings"), F.round(F.sum("a") * 1000000, 3).alias("area"))


@query("fence", "SELECT fid, 0 AS outside, true AS numbered, true AS by_part FROM fence")
def q_parts_boot(v: Views):
    """Tiles lie in their fence or within a radius of its sides, are numbered from 0, and each part has those that it has as a fence alone."""
    tiles = bootstrap.by_radius(v.part_edge, 70.0)
    own = tiles.withColumnRenamed("fid", "own")
    near = edge_distances(own, v.part_edge, ["own", "seq"], 70.0).where("own = fid").select("fid", "seq")
    good = near.union(pip_join(own, v.part_edge, ["own", "seq"]).where("own = fid").select("fid", "seq")).distinct().withColumn("good", F.lit(1))
    alone = bootstrap.by_radius(v.part_edge.withColumn("fid", F.col("fid") * 2 + F.col("part")).drop("part"), 70.0)
    alone = alone.select(F.floor(F.col("fid") / 2).alias("fid"), (F.col("fid") % 2).cast("int").alias("part"), "lat", "lon", F.lit(1).alias("same"))
    each = tiles.join(good, ["fid", "seq"], "left").join(alone, ["fid", "part", "lat", "lon"], "full")
    return each.groupBy("fid").agg(F.count_if(F.col("good").isNull()).cast("int").alias("outside"), (F.max("seq") == F.count("seq") - 1).alias("numbered"), (F.count("same") == F.count("*")).alias("by_part"))


def _share(a: str, b: str) -> str:
    """Pairs of fences of straight angles that share area: some cell between their corners' coordinates has its middle in both."""
    both = f"SELECT DISTINCT a.fid AS a, b.fid AS b FROM ({a}) a JOIN ({b}) b ON a.fid <= b.fid + 2000"
    grid = lambda c, n: f"SELECT a, b, ({n} + lead({n}) OVER (PARTITION BY a, b ORDER BY {n})) / 2 AS m{n} FROM (SELECT a, b, {c}1 AS {n} FROM pairs JOIN ({a}) e ON e.fid = a UNION SELECT a, b, {c}1 FROM pairs JOIN ({b}) e ON e.fid = b)"
    box = lambda t: f"SELECT fid, min(ex1) AS w, max(ex1) AS e, min(ey1) AS s, max(ey1) AS n FROM ({t}) GROUP BY fid"
    inside = lambda t, k: f"(SELECT count(*) FROM ({t}) e WHERE e.fid = {k} AND ((e.ey1 > mn) <> (e.ey2 > mn)) AND me < (e.ex2-e.ex1)*(mn-e.ey1)/(e.ey2-e.ey1)+e.ex1) % 2 = 1"
    return (
        f"SELECT DISTINCT a, b FROM (WITH pairs AS (SELECT p.a, p.b FROM ({both}) p JOIN ({box(a)}) x ON x.fid = p.a JOIN ({box(b)}) y ON y.fid = p.b WHERE x.w < y.e AND y.w < x.e AND x.s < y.n AND y.s < x.n), "
        f"xs AS ({grid('ex', 'e')}), ys AS ({grid('ey', 'n')}) SELECT a, b, me, mn FROM xs JOIN ys USING (a, b) WHERE me IS NOT NULL AND mn IS NOT NULL) WHERE {inside(a, 'a')} AND {inside(b, 'b')}"
    )


@query("shape_edge inner_edge", _share("SELECT * FROM shape_edge", "SELECT * FROM inner_edge"))
def q_ui_filter_shapes(v: Views):
    """Ls, boxes and outlines against fences with holes and small boxes: nested, in a hole, in an L's corner, equal."""
    return polygons.intersecting(v.shape_edge, v.inner_edge)


_MOVED = "SELECT fid, part, ring, seq, ex1 + CAST(0.0042 AS DOUBLE) AS ex1, ey1 + CAST(0.0012 AS DOUBLE) AS ey1, ex2 + CAST(0.0042 AS DOUBLE) AS ex2, ey2 + CAST(0.0012 AS DOUBLE) AS ey2 FROM part_edge"


@query("part_edge", _share(_MOVED, "SELECT * FROM part_edge"))
def q_parts_intersecting(v: Views):
    """Fences of several parts, moved, and those that they share area with."""
    moved = v.part_edge.select("fid", "part", "ring", "seq", *(F.expr(f"{c} + cast({d} as double)").alias(c) for c, d in (("ex1", 0.0042), ("ey1", 0.0012), ("ex2", 0.0042), ("ey2", 0.0012))))
    return polygons.intersecting(moved, v.part_edge)
