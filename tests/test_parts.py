"""Fences of several polygons: areas, cutouts and texts of two squares, collections inside collections, shapefile rings."""

import json

from terracover.operators import client, formats, render, stats
from terracover.sources import readers

A = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
B = [[x + 2, y] for x, y in A]
HOLE = [[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.4], [0.2, 0.2]]


def edges(spark, *geometries):
    rows = [(k, json.dumps(g) if g is not None else None) for k, g in enumerate(geometries)]
    return readers.edges_of(spark.createDataFrame(rows, "seq long, geometry string"))


def test_two_squares(spark):
    e = edges(spark, {"type": "MultiPolygon", "coordinates": [[A], [B]]}, {"type": "Polygon", "coordinates": [A]}, {"type": "MultiPolygon", "coordinates": [[A, HOLE], [B]]})
    area = {r.fid: r.area for r in stats.area(e).collect()}
    assert abs(area[0] - 2 * area[1]) <= 1 and area[1] < area[2] < area[0]
    assert {(r.fid, r.part, r.ring) for r in client.cutouts(e).collect()} == {(2, 0, 1)}
    sql = {r.fid: r.sql for r in formats.sql_contains(formats.rings(e)).collect()}
    body = json.loads(sql[0][sql[0].index("{") : sql[0].index("}") + 1])
    assert body == {"type": "MultiPolygon", "coordinates": [[A], [B]]} and '"Polygon"' in sql[1]


def test_collections(spark):
    inner = {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [[B], [A, HOLE]]}, {"type": "Point", "coordinates": [1, 1]}]}
    deep = {"type": "Polygon", "coordinates": [A]}
    for _ in range(8):
        deep = {"type": "GeometryCollection", "geometries": [deep]}
    e = edges(spark, {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [A]}, inner, {"type": "LineString", "coordinates": A}]}, deep, {"type": "GeometryCollection", "geometries": []}, None, {"type": "Polygon", "coordinates": []})
    got = {(r.fid, r.part, r.ring): r["count"] for r in e.groupBy("fid", "part", "ring").count().collect()}
    assert got == {(0, 0, 0): 4, (0, 1, 0): 4, (0, 2, 0): 4, (0, 2, 1): 4, (1, 0, 0): 4}


def test_rendered_and_read_again(spark):
    shape = {"type": "MultiPolygon", "coordinates": [[A, HOLE], [B]]}
    e = edges(spark, shape)
    one = render.parts_of(formats.rings(e), spark.createDataFrame([(0, "two")], "fid long, name string"))
    for form in ("geometry", "feature", "feature_collection", "geometry_vec", "feature_vec"):
        doc = json.loads(render.rendered(one, form).first().out)
        assert [f["geometry"] for f in formats.to_features(doc)] == [shape]
    assert len(json.loads(render.rendered(one, "multi_array").first().out)) == 3
    assert [(r.part, len(r.rings)) for r in formats.exploded(e).orderBy("part").collect()] == [(0, 2), (1, 1)]


def test_shapefile_rings():
    turned = [r[::-1] for r in (A, B)]
    assert readers._of_rings([turned[0], turned[1], HOLE]) == {"type": "MultiPolygon", "coordinates": [[turned[0], HOLE], [turned[1]]]}
    assert readers._of_rings([turned[0], HOLE]) == {"type": "Polygon", "coordinates": [turned[0], HOLE]}
    assert readers._of_rings([A, HOLE]) == {"type": "Polygon", "coordinates": [A, HOLE]} and readers._of_rings([])["coordinates"] == []
