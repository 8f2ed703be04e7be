"""Work that must not grow with the square of the points in one place."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terracover.functions import s2
from terracover.operators import cover, joins, routing, stats
from terracover.plans import further, spatial  # noqa: F401  they fill the registry
from terracover.plans.registry import QUERIES
from terracover.sources import fixtures


def _dense(n, spread=0.004, seed=5):
    rng = np.random.default_rng(seed)
    lat, lon = 40 + rng.integers(0, 2000, n) * spread / 2000, -74 + rng.integers(0, 2000, n) * spread / 2000
    order = np.lexsort((lon, lat))
    return lat[order], lon[order]


@pytest.mark.parametrize("mode, n, least, most", [("fast", 3000, 1, 0), ("fast", 20000, 3, 0), ("fast", 20000, 3, 4), ("better", 2000, 3, 0), ("best", 300, 3, 0), ("honeycomb", 3000, 3, 0)])
def test_raster_cover_is_the_cover_by_members(monkeypatch, mode, n, least, most):
    lat, lon = _dense(n)
    assert cover.Raster.of(lat, lon, 70.0) is not None
    got = cover.cover_group(lat, lon, 70.0, least, mode, most, density=60)
    monkeypatch.setattr(cover.Raster, "of", staticmethod(lambda *_: None))
    want = cover.cover_group(lat, lon, 70.0, least, mode, most, density=60)
    assert len(want[0]) and all(np.array_equal(a, b) for a, b in zip(got, want))


def test_raster_maps_are_of_one_size():
    """What is kept of a disc does not grow with its points."""
    sizes = []
    for n in (2000, 40000):
        lat, lon = _dense(n)
        y, x = cover.grid_candidates(lat, lon, 70.0, 20)
        parts = list(cover.Raster.of(lat, lon, 70.0).discs(y, x))
        points, maps = np.zeros(len(y), int), sum(p[3].nbytes for p in parts)
        for p in parts:
            points[p[0]] = p[4]
        ptr, _ = cover.disc_members(y, x, lat, lon, 70.0)
        assert np.array_equal(points, np.diff(ptr))
        sizes.append(maps)
    assert sizes[1] <= sizes[0] * 1.1


def test_cover_of_single_points_leaves_none():
    """Points that share an identity cell with a covered one need a disc too."""
    lat, lon = _dense(20000)
    y, x = cover.cover_group(lat, lon, 70.0, 1, "fast", density=40)
    covered = np.zeros(len(lat), bool)
    covered[cover.disc_members(y, x, lat, lon, 70.0)[1]] = True
    assert covered.all()


def test_tiled_cover_of_single_points_leaves_none(spark):
    lat, lon = _dense(6000)
    rows = spark.createDataFrame([(0, k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))], "fid long, id long, lat double, lon double")
    found = cover.tiled_cover(rows, 70.0, 1, "fast", density=12).toPandas()
    covered = np.zeros(len(lat), bool)
    covered[cover.disc_members(found["lat"].to_numpy(), found["lon"].to_numpy(), lat, lon, 70.0)[1]] = True
    assert covered.all()


def test_circles_together_are_each_circle(monkeypatch):
    """Over the cube's edges and corners too, in one pass and not one circle at a time."""
    rng = np.random.default_rng(2)
    lat = np.r_[40 + rng.random(20) * 0.04, 45 + rng.random(5) * 0.001, 35.26439, 90.0, np.nan]
    lon = np.r_[-74 + rng.random(20) * 0.04, rng.random(5) * 0.001, 45.0, 0.0, 1.0]
    want = [s2.circle_cover(y, x, 200.0, 17) for y, x in zip(lat[:-1], lon[:-1])]
    monkeypatch.setattr(s2, "circle_cover", None)
    got = s2.circle_covers(lat, lon, 200.0, 17)
    assert len(got) == len(lat) and not len(got[-1]) and all(np.array_equal(a, b) for a, b in zip(got, want))


def test_nearest_between_is_nearest_of_all_pairs_but_meets_few(spark, monkeypatch):
    """Tours beside, over and far from each other, one of them across 180 degrees, one of a single stop."""
    rng = np.random.default_rng(4)
    at = {0: (40, -74, 400), 1: (40, -73.99, 400), 2: (40.002, -73.992, 300), 3: (41, -70, 1), 4: (-10, 179.999, 200), 5: (-10, -179.995, 200)}
    rows = [(f, k, float(y + a), float((x + b + 180) % 360 - 180)) for f, (y, x, n) in at.items() for k, (a, b) in enumerate(rng.random((n, 2)) * 0.009)]
    stops = spark.createDataFrame(rows, "fid long, seq long, lat double, lon double")
    a = stops.selectExpr("fid key", "fid + 1 next_key", "seq a_seq", "lat a_lat", "lon a_lon")
    b = stops.selectExpr("fid next_key", "seq b_seq", "lat b_lat", "lon b_lon")
    want, met, plain = sorted(map(tuple, joins.nearest_pairs(a.join(b, "next_key")).collect())), [], joins.nearest_pairs
    monkeypatch.setattr(joins, "nearest_pairs", lambda t: (met.append(t.count()), plain(t))[1])
    assert sorted(map(tuple, joins.nearest_between(a, b).collect())) == want and len(want) == 5
    assert met[0] < a.join(b, "next_key").count() / 20


def _shuffled(spark, df):
    """The rows that a frame's stages hand over, and its own rows."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for a in [store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())] for k in range(a.size()) for s in (a.apply(k),)}
    before, rows = stages(), sorted(map(tuple, df().collect()))
    return sum(n for k, n in stages().items() if k not in before), rows


def test_pairs_of_dense_points_are_not_shuffled(spark):
    lat, lon = _dense(3000, spread=0.001)
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))], "id long, lat double, lon double")
    discs = points.where("id % 25 = 0").withColumnRenamed("id", "cid")
    pairs = joins.radius_join(points, discs, 70.0, ["id"], ["cid"])
    met = pairs.count()
    got, counts = _shuffled(spark, lambda: stats.cluster_counts(pairs, discs))
    assert met > 200_000 and got < met / 5
    near = cover.metres_between(lat[None], lon[None], lat[::25, None], lon[::25, None]) <= 70.0
    assert counts == [(25 * k, int(n.sum()), int((n & (near.sum(axis=0) == 1)).sum())) for k, n in enumerate(near)]
    got, claims = _shuffled(spark, lambda: cover.nearby_claims(points, discs, 70.0))
    assert got < met / 5 and claims == sorted(map(tuple, cover.first_claims(pairs, stats.cluster_counts(pairs, discs)).collect()))


def _peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tours_hold_no_pairs_of_all_stops():
    """What a tour holds grows with its stops, and its neighbours are the nearest of all stops."""
    rng = np.random.default_rng(4)
    lat, lon = 40 + rng.random(24000) * 0.01, -74 + rng.random(24000) * 0.01
    order, peak = _peak(lambda: routing.tour_order(lat, lon, rounds=0))
    assert sorted(order.tolist()) == list(range(24000)) and peak < 150
    for y, x in ((lat[:900], lon[:900]), (np.round(lat[:900], 3), np.round(lon[:900], 3)), (lat[:25], lon[:25])):
        d = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
        d[np.arange(len(y)), np.arange(len(y))] = np.inf
        near, far = routing.nearest(y, x, 24)
        assert np.array_equal(far, np.sort(d, axis=1)[:, :24]) and np.array_equal(np.take_along_axis(d, near.astype(int), axis=1), far)


def test_joined_tours_hold_no_pairs_of_all_stops():
    rng = np.random.default_rng(5)
    p, q = (np.stack([40 + rng.random(5000) * 0.01, lon + rng.random(5000) * 0.01], axis=1) for lon in (-74.0, -73.9905))
    p, q = p[np.argsort(p[:, 0])], q[np.argsort(q[:, 0])]
    at, peak = _peak(lambda: routing.closest(p, q))
    d = cover.metres_between(p[:, None, 0], p[:, None, 1], q[None, :, 0], q[None, :, 1]).min(axis=1)
    assert at == int(np.argmin(d)) and peak < 50
    assert routing.closest(p[:3], p[:3]) == 0


def test_wide_cover_is_the_greedy_cover(spark):
    """The same discs, though only points that a candidate reaches meet; all points are counted."""
    rng = np.random.default_rng(6)
    rows = [(k % 2, 40 + float(y), -74 + float(x)) for k, (y, x) in enumerate(rng.integers(0, 400, (6000, 2)) * 0.00005)]
    points = spark.createDataFrame(rows + [(2, 41.0, -74.0)] * 3 + [(3, 42.0, -74.0), (3, None, -74.0)], "fid long, lat double, lon double")
    got = cover.wide_cover(points, 70.0, 3, "fast", F.col("fid") % 2, density=40)
    want = cover.greedy_cover(points, 70.0, 3, "fast", F.col("fid") % 2, density=40)
    assert sorted(got.collect()) == sorted(want.collect())
    assert {r.fid: r.points for r in got.collect()} == {0: 3000, 1: 3000}
    for mode, least in (("better", 3), ("fast", 1)):
        with pytest.raises(ValueError):
            cover.wide_cover(points, 70.0, least, mode)


def test_wide_queries_meet_only_reached_points(spark, monkeypatch):
    """The wide queries bring no whole group into one task."""
    monkeypatch.setattr(cover, "greedy_cover", None)
    for name in ("q_clu_wide_fast", "q_clu_wide_balanced"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").schema.names[0] == "fid"


def test_best_cover_lists_no_meeting_points(monkeypatch):
    """Every disc taken covers as many free cells as any meeting point of two rims could, and memory does not grow with their number."""
    lat, lon = _dense(700)
    _, identity = np.unique(s2.cell_ids(lat, lon, cover.IDENTITY_LEVEL), return_inverse=True)
    monkeypatch.setattr(cover, "PAIRS", 0)
    found = cover.Raster.of(lat, lon, 70.0, 8.0).widest(3, 0)
    _, _, ptr, members = cover._kept(cover.candidates(lat, lon, 70.0, "best"), lat, lon, 70.0, 3)
    sets = [np.unique(identity[members[ptr[c] : ptr[c + 1]]]) for c in range(len(ptr) - 1)]
    own, size, free = np.concatenate(sets), np.cumsum([0, *map(len, sets)]), np.ones(identity.max() + 1, bool)
    most = lambda: int(np.add.reduceat(free[own], size[:-1], dtype=int).max())
    for y, x in zip(*found):
        cells = identity[cover.disc_members(np.array([y]), np.array([x]), lat, lon, 70.0)[1]]
        assert free[np.unique(cells)].sum() == most()
        free[cells] = False
    assert most() < 3 and len(found[0]) > 10
    monkeypatch.setattr(cover, "meeting_points", None)
    lat, lon = _dense(12000, spread=0.0015)
    got, peak = _peak(lambda: cover.cover_group(lat, lon, 70.0, 3, "best"))
    assert len(got[0]) and peak < 300


@pytest.mark.parametrize("least, tiles", [(1, (4, 16, 1 << 40)), (3, (8, 1 << 40))])
def test_wide_fastest_cover_is_the_fastest_cover(spark, monkeypatch, least, tiles):
    """The same discs in the same order, in whatever tiles cells are merged."""
    rng = np.random.default_rng(7)
    rows = [(k % 2, 40 + float(y), -74 + float(x)) for k, (y, x) in enumerate(rng.integers(0, 4000, (9000, 2)) * 0.00001)]
    points = spark.createDataFrame(rows + [(2, 41.0, -74.0)] * 3 + [(-3, 42.0, -74.0), (3, None, -74.0)], "fid long, lat double, lon double")
    monkeypatch.setattr(cover, "MERGE_TILES", tiles)
    plain = cover.fastest_cover(points, 70.0, least, F.col("fid") % 2)
    monkeypatch.setattr(cover, "fastest_cover", None)
    got, want = (df.select("fid", "split", "cid", F.round("lat", 9), F.round("lon", 9), "points", "covered") for df in (cover.wide_fastest_cover(points, 70.0, least, F.col("fid") % 2), plain))
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want
    assert QUERIES["q_clu_wide_fastest"](spark, "/root/testdata/sf0.001").count()


def test_rows_of_a_matrix_are_dealt_out(spark):
    """A tour's rows are made in several tasks, each of at most some part of them."""
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["q_dist_matrix"](spark, sf).groupBy("fid", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    stops = fixtures.view(spark, sf, "route_point").groupBy("fid").agg(F.count("*").alias("stops"))
    tours = rows.groupBy("fid").agg(F.sum("n").alias("n"), F.max("n").alias("most")).join(stops, "fid").collect()
    assert len(tours) == stops.count() and all(t.n == t.stops**2 for t in tours)
    assert max(t.stops for t in tours) > 5 and all(t.most < t.n for t in tours if t.stops > 5)


def test_exposed_points_grow_slower_than_points_and_have_the_candidates_of_all(spark):
    kept = []
    for n in (20000, 120000):
        lat, lon = _dense(n, spread=0.002)
        rows = spark.createDataFrame(pd.DataFrame({"fid": 0, "lat": lat, "lon": lon}))
        few = cover.exposed(rows, 70.0).toPandas().sort_values(["lat", "lon"])
        want, got = cover.s2_candidates(lat, lon, 70.0), cover.s2_candidates(few["lat"].to_numpy(), few["lon"].to_numpy(), 70.0)
        assert len(want[0]) and all(np.array_equal(a, b) for a, b in zip(got, want))
        kept.append(len(few))
    assert kept[0] < 10000 and kept[1] < kept[0] * 2
