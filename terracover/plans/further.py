"""Queries of sources, rendering, cell functions, dispatch and combined edits."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terracover import engine
from terracover.functions import geo, props, s2
from terracover.operators import bootstrap, client, cover, formats, plugins, polygons, render
from terracover.operators.grouping import dealt
from terracover.operators.joins import pip_join, radius_join
from terracover.plans import s2sql
from terracover.plans.registry import Views, inside, query
from terracover.sources import readers
from terracover.streaming import live

SUMS = "count(*) AS edges, round(sum(ex1), 5) AS x, round(sum(ey1), 5) AS y, round(sum(ex1*ey2 - ex2*ey1)*1000000, 2) AS area"
EDGE_COUNTS = f"SELECT fid, {SUMS} FROM edge GROUP BY fid"


def _sums(edges):
    """Edges per fence with the sums of their coordinates and twice their area."""
    area = F.col("ex1") * F.col("ey2") - F.col("ex2") * F.col("ey1")
    return edges.groupBy("fid").agg(F.count("*").alias("edges"), F.round(F.sum("ex1"), 5).alias("x"), F.round(F.sum("ey1"), 5).alias("y"), F.round(F.sum(area) * 1000000, 2).alias("area"))


def _features(v: Views):
    return render.parts_of(formats.rings(v.edge), v.fence)


def _parsed(v: Views, form: str):
    """Edges per fence after rendering in a form and reading it back."""
    docs = render.rendered(_features(v), form).select(F.col("fid").cast("string").alias("path"), F.col("out").alias("text"))
    return _sums(readers.edges_of(readers.parse_areas(docs), "path"))


@query("edge", EDGE_COUNTS)
def q_src_geojson(v: Views):
    return _parsed(v, "feature_collection")


@query("edge", EDGE_COUNTS)
def q_from_geometry(v: Views):
    return _parsed(v, "geometry")


@query("edge", EDGE_COUNTS)
def q_from_multi_array(v: Views):
    return _parsed(v, "multi_array")


@query("edge", EDGE_COUNTS)
def q_from_multi_struct(v: Views):
    return _parsed(v, "multi_struct")


@query("edge", EDGE_COUNTS)
def q_src_shapefile(v: Views):
    """Fences as the bytes of shapefiles, read again."""

    def packed(batches):
        for b in batches:
            for name, rings in zip(b["path"], b["rings"], strict=True):
                points = [p for r in rings for p in r]
                starts = np.cumsum([0, *map(len, rings[:-1])])
                flat = struct.pack(f"<{2 * len(points)}d", *(c for p in points for c in (p["lon"], p["lat"])))
                body = struct.pack("<i4dii", 5, *(f(p[c] for p in points) for f, c in ((min, "lon"), (min, "lat"), (max, "lon"), (max, "lat"))), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + flat
                yield pd.DataFrame({"path": [name], "content": [bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body]})

    rings = formats.rings(v.edge).groupBy(F.col("fid").cast("string").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("r"))
    files = rings.select("path", F.transform("r", lambda r: r["points"]).alias("rings")).mapInPandas(packed, "path string, content binary")
    return _sums(readers.edges_of(readers.parse_shapefiles(files), "path"))


@query("fence", "SELECT name, CASE WHEN fid % 3 = 0 THEN 'alt_text' WHEN fid % 3 = 1 THEN 'feature' ELSE 'single_array' END AS form FROM fence")
def q_return_type(v: Views):
    """The asked return type by name, whatever its case and separators; else the input's own."""
    asked = ("Alt_Text", "feature", "nothing of the kind")
    known = F.create_map(*(F.lit(x) for k, a in enumerate(asked) for x in (k, formats.return_type(a, "single_array"))))
    return v.fence.select("name", F.get(F.array(known), F.lit(0))[(F.col("fid") % 3).cast("int")].alias("form"))


@query("route_point", "SELECT fid, seq, lat, lon FROM route_point WHERE fid NOT IN (SELECT fid FROM route_point GROUP BY fid HAVING count(*) > 60)")
def q_ui_remove_this(v: Views):
    large = v.route_point.groupBy("fid").agg(F.count("*").alias("n")).where("n > 60")
    return v.route_point.join(large, "fid", "left_anti").select("fid", "seq", "lat", "lon")


def _outer(v: Views, form: str):
    one = render.parts_of(formats.rings(v.edge.where("ring = 0")), v.fence)
    docs = render.rendered(one, form).select(F.col("fid").cast("string").alias("path"), F.col("out").alias("text"))
    return _sums(readers.edges_of(readers.parse_areas(docs), "path"))


OUTER = f"SELECT fid, {SUMS} FROM edge WHERE ring = 0 GROUP BY fid"


@query("edge", OUTER)
def q_src_text(v: Views):
    return _outer(v, "text")


@query("edge", OUTER)
def q_src_alt_text(v: Views):
    return _outer(v, "alt_text")


@query("edge", OUTER)
def q_src_poracle(v: Views):
    return _outer(v, "poracle")


@query("edge", OUTER)
def q_from_single_array(v: Views):
    return _outer(v, "single_array")


@query("edge", OUTER)
def q_from_single_struct(v: Views):
    return _outer(v, "single_struct")


@query()
def q_sink_response(v: Views):
    """Every return type of every fence."""
    forms = [f for f in dict.fromkeys(formats.RETURN_TYPES.values()) if f != "sql"]
    out = None
    for f in forms:
        one = render.rendered(_features(v), f).withColumn("form", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


@query("fence", "SELECT fid, t AS geo_type, CAST(n AS INT) AS n FROM fence, (VALUES ('Point', 2), ('MultiPoint', 5), ('Polygon', 1), ('MultiPolygon', 1)) AS k(t, n)")
def q_geometry_coerce(v: Views):
    one = render.parts_of(formats.rings(v.edge.where("ring = 0")), v.fence)
    out = None
    for t in ("Point", "MultiPoint", "Polygon", "MultiPolygon"):
        rows = one.select("fid", F.lit(t).alias("geo_type"), F.size(render.coerced(F.col("parts"), t)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("instance", "SELECT id, concat_ws('__', CAST(id AS VARCHAR), type, 'SCANNER') AS fid, 1 AS n, CAST('40.' || (id + 10) AS DOUBLE) AS lat, CAST('-74.' || (id + 10) AS DOUBLE) AS lon FROM instance")
def q_instance_to_feature(v: Views):
    points = formats.parse_text(F.col("data"))
    return v.instance.select("id", F.concat_ws("__", F.col("id").cast("string"), "type", F.lit("SCANNER")).alias("fid"), F.size(points).alias("n"), F.get(points, F.lit(0))["lat"].alias("lat"), F.get(points, F.lit(0))["lon"].alias("lon"))


@query("instance", "SELECT id, CASE WHEN id % 3 = 0 THEN 70 END AS radius, 1 AS n FROM instance")
def q_parse_scanner_instance(v: Views):
    """A text or a JSON document with an area and an optional radius."""
    docs = v.instance.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"radius":70,"area":[{"lat":1,"lon":2}]}'))).otherwise(F.col("data")).alias("d"))
    is_json = F.trim("d").startswith("{")
    area = F.from_json(F.get_json_object("d", "$.area"), "array<struct<lat:double,lon:double>>")
    return docs.select("id", F.when(is_json, F.get_json_object("d", "$.radius").cast("int")).alias("radius"), F.when(is_json, F.size(area)).otherwise(F.size(formats.parse_text(F.col("d")))).alias("n"))


@query("area", "SELECT id, concat_ws('__', CAST(id AS VARCHAR), 'circle_raid', 'SCANNER') AS fid, 1 AS n, CAST(40.5 AS DOUBLE) AS lat, CAST(-74.5 AS DOUBLE) AS lon FROM area WHERE fort_mode_route IS NOT NULL")
def q_area_to_feature(v: Views):
    rows, points = v.area.where("fort_mode_route is not null"), formats.parse_text(F.col("fort_mode_route"))
    return rows.select("id", F.concat_ws("__", F.col("id").cast("string"), F.lit("circle_raid"), F.lit("SCANNER")).alias("fid"), F.size(points).alias("n"), F.get(points, F.lit(0))["lat"].alias("lat"), F.get(points, F.lit(0))["lon"].alias("lon"))


@query("fence", "SELECT fid, concat('{\"type\":\"Polygon\",\"id\":', CAST(fid AS VARCHAR), '}') AS geometry FROM fence")
def q_etl_geometry_extract(v: Views):
    area = F.concat(F.lit('{"geometry":{"type":"Polygon","id":'), F.col("fid").cast("string"), F.lit("}}"))
    return v.fence.select("fid", F.get_json_object(area, "$.geometry").alias("geometry"))


@query("fence", "SELECT CAST(parent AS BIGINT) AS parent, CAST(sum(CASE WHEN fid%2=1 THEN 2 ELSE 1 END) AS BIGINT) AS rings, round(sum((x1-x0)*(y1-y0) - CASE WHEN fid%2=1 THEN (x1-x0-0.0052)*(y1-y0-0.0052) ELSE 0 END) * 1000000, 3) AS area FROM fence GROUP BY parent")
def q_agg_union_by_property(v: Views):
    """Union of the fences of each parent: disjoint here, so rings and areas add up."""
    e = v.edge.join(v.fence.select("fid", "parent"), "fid")
    rows = e.select("parent", "fid", "ring", "seq", "ex1", "ey1")
    out = polygons.union_by(rows, "parent")
    w = out.groupBy("parent", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    n = F.size("p")
    term = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, k: a + F.get("p", k)["x"] * F.get("p", (k + 1) % n)["y"] - F.get("p", k)["y"] * F.get("p", (k + 1) % n)["x"])
    return w.select("parent", (term / 2).alias("a")).groupBy("parent").agg(F.count("*").alias("rings"), F.round(F.sum("a") * 1000000, 3).alias("area"))


@query("fence", "SELECT CAST(parent AS BIGINT) AS parent, count(*) AS rings FROM fence GROUP BY parent")
def q_ui_combine(v: Views):
    """Polygons of a parent united, holes dropped."""
    e = v.edge.join(v.fence.select("fid", "parent"), "fid").select("parent", "fid", "ring", "seq", "ex1", "ey1")
    return polygons.union_by(e, "parent", drop_holes=True).groupBy("parent").agg(F.countDistinct("ring").alias("rings"))


@query("spawnpoint edge", f"SELECT count(DISTINCT id) AS total FROM ({inside('spawnpoint')})")
def q_area_stats(v: Views):
    return engine.area_stats(v.spawnpoint, v.edge)


@query()
def q_clu_dispatch(v: Views):
    """Clusters of every fence per mode."""
    out = None
    for mode in engine.SLOWEST_FIRST:
        one = engine.clusters(v.spawnpoint, v.edge, engine.Args(min_points=3, cluster_mode=mode)).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mode", "fid").agg(F.count("*").alias("clusters"))


@query()
def q_boot_dispatch(v: Views):
    a = engine.bootstrapped(v.edge, engine.Args(sort_by="s2")).withColumn("mode", F.lit("radius"))
    return a.unionByName(engine.bootstrapped(v.edge, engine.Args(calculation_mode="s2", s2_level=17, s2_size=3)).withColumn("mode", F.lit("s2")))


@query()
def q_route_stats(v: Views):
    a = engine.Args(min_points=3, cluster_mode="fastest", sort_by="geohash")
    points = engine.area_points(v.spawnpoint, v.edge)
    return engine.route_stats(engine.clusters(v.spawnpoint, v.edge, a), points, a)


def _candidates(points, make):
    def run(key, g):
        g = g.sort_values(["lat", "lon"])
        y, x = make(g["lat"].to_numpy(float), g["lon"].to_numpy(float))
        return pd.DataFrame({"fid": key[0], "cid": np.arange(len(y)), "lat": y, "lon": x})

    return dealt(points, "fid").groupBy("fid").applyInPandas(run, "fid long, cid long, lat double, lon double")


@query()
def q_cand_grid(v: Views):
    return _candidates(pip_join(v.spawnpoint, v.edge, ["lat", "lon"]), lambda y, x: cover.grid_candidates(y, x, 70.0, cover.DENSITY["fast"]))


@query()
def q_cand_s2(v: Views):
    """The candidates depend only on where a disc reaches a point."""
    points = cover.exposed(pip_join(v.spawnpoint, v.edge, ["lat", "lon"]), 70.0)
    return _candidates(points, lambda y, x: cover.s2_candidates(y, x, 70.0))


@query()
def q_cand_honeycomb(v: Views):
    return _candidates(pip_join(v.spawnpoint, v.edge, ["lat", "lon"]), lambda y, x: next(cover.candidates(y, x, 70.0, "honeycomb")))


@query("spawnpoint cluster", f"SELECT {s2sql.signed(s2sql.cell(17))} AS cell, n FROM ({s2sql.around('SELECT * FROM spawnpoint', 'SELECT * FROM cluster', 17, 1)})")
def q_cell_hash_join(v: Views):
    return cover.s2_block_cover(v.spawnpoint, v.cluster.select(s2.cell(F.col("lat"), F.col("lon"), 17).alias("cell")), 17, 3, 1)


@query()
def q_s2_polygons(v: Views):
    ids = v.gym.select(s2.cell(F.col("lat"), F.col("lon"), 15).alias("cell")).distinct()
    return ids.select(s2.unsigned(F.col("cell")).alias("cell"), s2.corners(F.col("cell")).alias("corners"))


@query("gym", f"SELECT CAST({s2sql.cell(15)} AS VARCHAR) AS cell, n FROM ({s2sql.around('SELECT * FROM gym', 'SELECT * FROM gym', 15, 7)})")
def q_s2_cell_coverage(v: Views):
    ids = v.gym.select("id", s2.cell(F.col("lat"), F.col("lon"), 15).alias("cell"))
    near = cover.s2_block_cover(v.gym, ids, 15, 15, 1)
    return near.select(s2.unsigned(F.col("cell")).alias("cell"), "n")


@query()
def q_s2_cell_intersects(v: Views):
    return bootstrap.by_s2(v.edge, 16, 1).select("fid", s2.unsigned(F.col("cell")).alias("cell"))


@query("gym", "SELECT id, (lat + CAST(40.5 AS DOUBLE)) / 2 AS lat, (lon + CAST(-74.5 AS DOUBLE)) / 2 AS lon FROM gym")
def q_fn_midpoint(v: Views):
    lat, lon = geo.midpoint(F.col("lat"), F.col("lon"), F.lit(40.5), F.lit(-74.5))
    return v.gym.select("id", lat.alias("lat"), lon.alias("lon"))


@query("geofence", "SELECT id, CASE WHEN geo_type IN ('Polygon', 'MultiPolygon') THEN 'auto_quest' ELSE 'unset' END AS mode FROM geofence")
def q_fn_enum_maps(v: Views):
    return v.geofence.select("id", props.default_mode(F.col("geo_type")).alias("mode"))


@query("route_point", "SELECT fid, seq, lat, lon FROM route_point WHERE fid IN (SELECT fid FROM route_point GROUP BY fid HAVING count(*) > 60)")
def q_ui_remove_others(v: Views):
    large = v.route_point.groupBy("fid").agg(F.count("*").alias("n")).where("n > 60")
    return v.route_point.join(large, "fid", "left_semi").select("fid", "seq", "lat", "lon")


@query("gym edge", f"SELECT DISTINCT id FROM ({inside('gym')})")
def q_ui_keep_points(v: Views):
    return client.filter_points(v.gym, v.edge, keep_inside=True).select("id")


@query()
def q_plugin_clustering(v: Views):
    def own(g, options):
        y, x = cover.unit_disc_cover(g["lat"].to_numpy(float), g["lon"].to_numpy(float), options["radius"], options["min_points"])
        return g.iloc[: len(y)].assign(lat=y, lon=x)

    plugins.register("clustering", "unit_disc", own)
    return plugins.run(pip_join(v.spawnpoint, v.edge, ["lat", "lon"]), "clustering", "unit_disc", "fid", radius=70.0, min_points=3)


@query("spawnpoint edge", f"SELECT fid, make_timestamp(CAST(floor(last_seen / 3600) * 3600 AS BIGINT) * 1000000) AS window_start, count(*) AS n FROM ({inside('spawnpoint', 'p.id, p.lat, p.lon, p.last_seen')}) GROUP BY 1, 2")
def q_live_counts(v: Views):
    points = v.spawnpoint.select("id", "lat", "lon", F.timestamp_seconds("last_seen").alias("ts"))
    out = live.fence_counts(points, v.edge, "1 hour")
    return out.select("fid", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


# One undivided region; at sf0.1 100,000 points, four to a disc.


@query()
def q_clu_wide_fastest(v: Views):
    return cover.wide_fastest_cover(v.wide, 70.0, 3)


@query()
def q_clu_wide_fast(v: Views):
    return cover.wide_cover(v.wide, 70.0, 3, "fast")


@query()
def q_clu_wide_balanced(v: Views):
    return cover.wide_cover(v.wide, 70.0, 3, "balanced")


@query()
def q_clu_wide_tiled(v: Views):
    """The same region cut into tiles, for regions that no single task can hold."""
    return cover.tiled_cover(v.wide, 70.0, 3, "fast")


@query("wide", "SELECT id FROM wide WHERE lat > 40.01")
def q_flt_wide(v: Views):
    return v.wide.where("lat > 40.01").select("id")
