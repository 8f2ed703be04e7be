"""The facade, readers, polygon union and the stream."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracover import engine
from terracover.operators import polygons
from terracover.sources import fixtures, readers
from terracover.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("options", [{"cluster_mode": "fastest"}, {"cluster_mode": "fast", "density": 48, "sort_by": "tsp"}, {"cluster_mode": "honeycomb"}, {"calculation_mode": "s2", "s2_level": 17, "s2_size": 3, "sort_by": "s2"}, {"cluster_mode": "fast", "density": 48, "cluster_split_level": 15, "center_clusters": True}])
def test_clusters_and_stats(spark, options):
    points, edges = fixtures.view(spark, SF, "spawnpoint"), fixtures.view(spark, SF, "edge")
    a = engine.Args(min_points=2, **options)
    found = engine.clusters(points, edges, a)
    rows = found.collect()
    assert rows and len({(r.fid, r.seq) for r in rows}) == len(rows)
    s = engine.route_stats(found, engine.area_points(points, edges), a).first()
    assert s.clusters == len(rows) and 0 < s.covered <= s.total and s.score == s.clusters * 2 + s.total - s.covered


def test_bad_arguments():
    with pytest.raises(ValueError):
        engine.Args(cluster_mode="worst")
    with pytest.raises(ValueError):
        engine.Args(cluster_split_level=31)


def test_readers(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5], [0.5, 0.5]]]}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": square, "properties": {"name": "sq"}}]}))
    f = readers.read_areas(spark, str(tmp_path / "a.json"))
    assert [r.name for r in f.collect()] == ["sq"] and readers.edges_of(f).count() == 8
    (tmp_path / "b.txt").write_text("0,0\n0,3\n3,3")
    assert readers.edges_of(readers.read_areas(spark, str(tmp_path / "b.txt"))).count() == 3
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    (tmp_path / "c.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    assert readers.edges_of(readers.read_shapefiles(spark, str(tmp_path))).count() == 3
    readers.write_result(f, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_union():
    box = lambda x, y, s=1.0: [np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]])]
    one = polygons.union([box(0, 0), box(0.5, 0.5)])
    assert len(one) == 1 and abs(polygons.area(one[0]) - 1.75) < 1e-9
    assert abs(sum(polygons.area(r) for r in polygons.union([box(0, 0), box(1, 0)])) - 2) < 1e-9
    assert sorted(round(polygons.area(r), 6) for r in polygons.union([box(0, 0), box(5, 5)])) == [1, 1]
    assert len(polygons.union([box(0, 0, 3), box(1, 1)])) == 1
    frame = [box(0, 0, 3)[0], box(1, 1)[0][::-1]]
    assert sorted(round(polygons.area(r), 6) for r in polygons.union([frame])) == [-1, 9]


def test_stream_matches_table(spark, tmp_path):
    edges = fixtures.view(spark, SF, "edge").cache()
    points = fixtures.view(spark, SF, "spawnpoint").select("id", "lat", "lon", F.timestamp_seconds("last_seen").alias("ts"))
    points.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = live.fence_counts(source, edges, lateness="3650 days").writeStream.outputMode("update").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.fid, r.window_start): r.n for r in spark.table("live").collect()}
    want = {(r.fid, r.window_start): r.n for r in live.fence_counts(points, edges).collect()}
    assert got == want and got


def test_area_ranges_reach_the_scan(spark, tmp_path):
    fixtures.view(spark, SF, "spawnpoint").write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stored = spark.read.parquet(str(tmp_path / "p"))
    out = engine.area_points(stored, fixtures.view(spark, SF, "edge"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and str(tmp_path) in x)
    assert "GreaterThanOrEqual(lon" in scan and "LessThanOrEqual(lat" in scan and "ReadSchema: struct<id:bigint,lat:double,lon:double>" in scan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
