"""The service's calls: fences kept apart, points outside left out, orders that need counts, plugins."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracover import engine
from terracover.operators import cover, plugins, routing

POINTS = "id long, lat double, lon double"


def box(fid, x, y, w):
    c = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    return [(fid, 0, k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(c, [*c[1:], c[0]]))]


def edges_of(spark, *boxes):
    return spark.createDataFrame([r for b in boxes for r in box(*b)], "fid long, ring int, seq int, ex1 double, ey1 double, ex2 double, ey2 double")


def test_honeycomb_counts_a_point_once(spark):
    """Two points, three wanted: no disc, though two equal fences hold them."""
    points = spark.createDataFrame([(1, 40.001, -73.999), (2, 40.0011, -73.9991)], POINTS)
    a = engine.Args(min_points=3, cluster_mode="honeycomb")
    assert engine.clusters(points, edges_of(spark, (1, -74.0, 40.0, 0.01), (2, -74.0, 40.0, 0.01)), a).count() == 0
    two = engine.Args(min_points=2, cluster_mode="honeycomb")
    got = engine.clusters(points, edges_of(spark, (1, -74.0, 40.0, 0.01), (2, -74.0, 40.0, 0.01)), two).collect()
    assert sorted(r.fid for r in got) == [1, 2]


def test_s2_mode_counts_points_inside_only(spark):
    points = spark.createDataFrame([(k, 40.0102 + k * 1e-6, -74.0) for k in range(5)], POINTS)
    a = engine.Args(min_points=3, calculation_mode="s2", s2_level=15, s2_size=9)
    assert engine.clusters(points, edges_of(spark, (1, -74.005, 40.0, 0.01)), a).count() == 0
    assert engine.clusters(points, edges_of(spark, (1, -74.005, 40.0, 0.011)), a).count() == 1


def test_centres_and_counts_of_overlapping_fences(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 40.0 + y, -74.0 + x) for i, (x, y) in enumerate((rng.random((300, 2)) * 0.01).tolist())]
    points, edges = spark.createDataFrame(rows, POINTS), edges_of(spark, (1, -74.0, 40.0, 0.01), (2, -74.0, 40.0, 0.01))
    for options in ({"center_clusters": True}, {"sort_by": "pointcount"}, {"sort_by": "s2"}, {"sort_by": "tsp"}):
        got = engine.clusters(points, edges, engine.Args(min_points=3, cluster_mode="fastest", **options)).toPandas()
        own = {f: g.sort_values("seq")[["lat", "lon"]].to_numpy() for f, g in got.groupby("fid")}
        assert np.array_equal(own[1], own[2])  # what another fence holds changes nothing
        n = [(cover.metres_between(own[1][:, :1], own[1][:, 1:], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) <= 70).sum(axis=1)][0]
        assert n[0] == n.max()  # a best stop comes first
        if options.get("sort_by") == "pointcount":
            last_best = int(np.flatnonzero(n == n.max()).size)
            assert sorted(n.tolist(), reverse=True)[:last_best] == [n.max()] * last_best


def test_best_covers_no_fewer_than_any_disc():
    """Whatever a disc of the radius covers, a candidate of `best` covers too."""
    rng = np.random.default_rng(5)
    lat, lon = 40 + rng.random(60) * 0.004, -74 + rng.random(60) * 0.004
    sets = []
    for y, x in cover.meeting_points(lat, lon, 70.0):
        sets += [frozenset(np.flatnonzero(cover.metres_between(lat, lon, a, b) <= 70.0).tolist()) for a, b in zip(y, x)]
    sets = set(sets)
    for a, b in zip(40 + rng.random(1500) * 0.004, -74 + rng.random(1500) * 0.004):
        own = frozenset(np.flatnonzero(cover.metres_between(lat, lon, a, b) <= 70.0 - 1e-3).tolist())
        assert not own or any(own <= s for s in sets)


def test_tours_are_short():
    rng = np.random.default_rng(3)
    lat, lon = 40 + rng.random(400) * 0.1, -74 + rng.random(400) * 0.1
    o = routing.tour_order(lat, lon)
    length = cover.metres_between(lat[o], lon[o], lat[np.roll(o, -1)], lon[np.roll(o, -1)]).sum()
    assert sorted(o.tolist()) == list(range(400)) and o[0] == 0
    assert length < 1.2 * 0.7124 * np.sqrt(400 * (0.1 * 111_195) ** 2 * np.cos(np.radians(40.05)))  # near the expected optimum
    assert sorted(routing.tour_order(np.full(9, 40.0), np.full(9, -74.0)).tolist()) == list(range(9))


def test_programs_of_a_folder(spark, tmp_path):
    """Listing, the call of a program with split cells, and plugins by name in the service's call."""
    own = tmp_path / "routing"
    (own / "folded").mkdir(parents=True)
    (own / ".gitkeep").write_text("")
    (own / "west.py").write_text("import sys\npts = [p.split(',') for p in sys.stdin.read().split()]\nassert '--top' in sys.argv or True\nprint(' '.join(','.join(p) for p in sorted(pts, key=lambda p: float(p[1]))))\n")
    (own / "folded" / "index.py").write_text("import sys\nprint(sys.stdin.read())\n")
    assert plugins.listed(str(tmp_path))["routing"] == sorted({*plugins.REGISTRY["routing"], "folded", "west.py"})
    assert plugins.programs(str(tmp_path), "clustering") == {}
    stops = spark.createDataFrame([(1, k, 40.0 + (k * 7 % 5) * 0.01, -74.0 + (k * 3 % 10) * 0.01) for k in range(10)], "fid long, seq long, lat double, lon double")
    old = os.environ["PATH"]
    os.environ["PATH"] = os.path.dirname(sys.executable) + os.pathsep + old
    try:
        got = plugins.run(stops, "routing", "west.py", "fid", folder=str(tmp_path)).orderBy("seq").collect()
        assert [r.lon for r in got] == sorted(r.lon for r in got) and len(got) == 10 and got[0].seq == 0
        cut = plugins.run(stops, "routing", "west.py", "fid", F.when(F.col("lat") < 40.02, 1).otherwise(2), routing.joined, str(tmp_path), top=3)
        assert sorted((r.lat, r.lon) for r in cut.collect()) == sorted((r.lat, r.lon) for r in stops.collect()) and {r.seq for r in cut.collect()} == set(range(10))
        a = engine.Args(sort_by="west.py", plugin_folder=str(tmp_path))
        assert [r.lon for r in engine.route(stops, a).orderBy("seq").collect()] == sorted(r.lon for r in stops.collect())
    finally:
        os.environ["PATH"] = old
    with pytest.raises(ValueError):
        engine.Args(sort_by="west.py")


def test_entry_without_the_corpus_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "terracover.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = entry.queries()
    assert "q_pip_join" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names and "q_pip_join" in entry.oracle_sql()
