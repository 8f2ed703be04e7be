"""Joins at the edges of the map, and fences of any size and shape."""

import numpy as np
from pyspark.sql import functions as F

from terracover.operators import cover
from terracover.operators.joins import fence_cells, _levels, in_any_fence, pip_join, radius_join, within_bounds


def test_pairs_across_180_degrees_and_at_the_poles(spark):
    rng = np.random.default_rng(4)
    lat = np.r_[rng.normal(0, 0.001, 60), rng.normal(65, 0.001, 60), 90 - rng.random(60) * 0.002, -90 + rng.random(60) * 0.002, 88.9995 + rng.random(60) * 0.001]
    lon = np.r_[180 + rng.normal(0, 0.001, 60), 180 + rng.normal(0, 0.002, 60), rng.random(60) * 360, rng.random(60) * 360, 180 + rng.normal(0, 0.05, 60)]
    lon = (lon + 180) % 360 - 180
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    df = spark.createDataFrame([*rows, (999, None, 1.0)], "id long, lat double, lon double")
    got = {(r.id, r.cid) for r in radius_join(df, df.withColumnRenamed("id", "cid"), 70.0, ["id"], ["cid"]).collect()}
    near = cover.metres_between(lat[:, None], lon[:, None], lat[None], lon[None]) <= 70.0
    assert got == set(map(tuple, np.argwhere(near).tolist()))
    ptr, own = cover.disc_members(lat, lon, lat, lon, 70.0)
    assert [sorted(own[a:b]) for a, b in zip(ptr, ptr[1:])] == [np.flatnonzero(x).tolist() for x in near]


def plain_inside(lat, lon, e):
    x1, y1, x2, y2 = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((y1 > lat[:, None]) != (y2 > lat[:, None])) & (lon[:, None] < (x2 - x1) * (lat[:, None] - y1) / (y2 - y1) + x1)
    return cross.sum(axis=1) % 2 == 1


def test_fences_of_any_size(spark):
    """A fence of 9 x 8 degrees with 10,000 edges and a hole, a tiny one inside it, one apart; every point by plain parity."""
    rng = np.random.default_rng(9)
    turn = np.arange(9000) * (2 * np.pi / 9000)
    wave = 1 + 0.2 * np.sin(40 * turn) + 0.02 * np.sin(900 * turn)
    large = np.stack([-70 + 3.7 * np.cos(turn) * wave, 45 + 3.3 * np.sin(turn) * wave], axis=1)
    hole = np.stack([-70 + np.cos(turn[::9]), 45 + np.sin(turn[::9])], axis=1)
    tiny = np.array([[-70.0, 45.0], [-69.998, 45.0], [-69.998, 45.002], [-70.0, 45.002]])
    apart = np.array([[10.0, 50.0], [10.02, 50.005], [10.0, 50.01]])
    rings = {1: [large, hole], 2: [tiny], 3: [apart]}
    rows = [(f, k, i, *map(float, a), *map(float, b)) for f, rs in rings.items() for k, r in enumerate(rs) for i, (a, b) in enumerate(zip(r, np.roll(r, -1, axis=0)))]
    edges = spark.createDataFrame(rows, "fid long, ring int, seq int, ex1 double, ey1 double, ex2 double, ey2 double")
    lon = np.r_[-76 + 12 * rng.random(20_000), -70.001 + 0.004 * rng.random(500), 9.99 + 0.04 * rng.random(500)]
    lat = np.r_[40.5 + 9 * rng.random(20_000), 44.999 + 0.004 * rng.random(500), 49.995 + 0.02 * rng.random(500)]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [(-1, None, None)], "id long, lat double, lon double").withColumn("gx", F.lit("mine"))
    want = {f: plain_inside(lat, lon, np.array([r[3:] for r in rows if r[0] == f])) for f in rings}
    got = {(r.fid, r.id) for r in pip_join(points, edges, ["id"]).collect()}
    assert got == {(f, i) for f, w in want.items() for i in np.flatnonzero(w).tolist()} and {f for f, _ in got} == {1, 2, 3}
    any_ = want[1] | want[2] | want[3]
    inside, outside = in_any_fence(within_bounds(points, edges), edges), in_any_fence(points, edges, inside=False)
    assert inside.columns == points.columns and sorted(r.id for r in inside.collect()) == np.flatnonzero(any_).tolist()
    assert sorted(r.id for r in outside.collect()) == [-1, *np.flatnonzero(~any_).tolist()]
    fences, levels = _levels(edges, 0.005)
    sizes = fence_cells(edges, fences, 0.005).where("fid = 1").agg(F.count("*"), F.sum(F.size("edges"))).first()
    assert len(levels) == 2 and sizes[0] < 5000 and sizes[1] < 60 * 10_000 and "NestedLoop" not in pip_join(points, edges, ["id"])._jdf.queryExecution().executedPlan().toString()
