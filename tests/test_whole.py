"""Results that a bound on cells, points or fences would cut."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terracover.functions import s2
from terracover.operators import bootstrap, cover, scans
from terracover.operators.joins import pip_join
from terracover.plans import further  # noqa: F401
from terracover.plans.registry import QUERIES
from terracover.sources import fixtures

SF = "/root/testdata/sf0.001"


def _edges(spark, fences):
    rows = []
    for fid, rings in fences.items():
        for k, r in enumerate(rings):
            rows += [(fid, k, i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(r, np.roll(r, -1, axis=0), strict=True))]
    return spark.createDataFrame(rows, "fid long, ring int, seq int, ex1 double, ey1 double, ex2 double, ey2 double")


def _plain_blocks(rings, level, size):
    """Every cell of the bounds against every ring, one by one."""
    e = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings])
    low, high = e.reshape(-1, 2).min(axis=0), e.reshape(-1, 2).max(axis=0)
    cells = s2.cover_rect(low[1], low[0], high[1], high[0], level)
    v = s2.vertices(cells)
    meets = bootstrap._parity(v.mean(axis=1), e) | bootstrap._parity(v[:, 0], e)
    meets |= [any(s2.polygons_meet(c, r[:, ::-1]) and (s2.segments_cross(c, r[:, ::-1]) or s2.inside(r[:1, ::-1], c)[0]) for r in rings) for c in v]
    face, i, j, _ = s2.to_face_ij(cells[meets])
    side = 1 << (s2.MAX_LEVEL - level)
    at = lambda a: a // (side * size) * side * size + size // 2 * side
    return set(s2.from_face_ij(face, at(i), at(j), level).tolist())


def test_s2_blocks_match_plain_search(spark):
    star = np.array([[-74.0 + (0.012 if k % 2 else 0.004) * np.cos(k * np.pi / 9), 40.0 + (0.012 if k % 2 else 0.004) * np.sin(k * np.pi / 9)] for k in range(18)])
    box = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]])
    fences = {1: [star], 2: [box(-74.05, 40.05, 0.02), box(-74.045, 40.055, 0.011)], 3: [box(10.0, 50.0, 0.001), box(10.01234, 50.01234, 0.00001)]}
    got = bootstrap.by_s2(_edges(spark, fences), 16, 3).toPandas()
    for fid, rings in fences.items():
        own = got[got["fid"] == fid].sort_values("seq")
        assert set(own["cell"]) == _plain_blocks(rings, 16, 3) and len(own) == own["cell"].nunique()
        assert own["seq"].tolist() == list(range(len(own))) and own["cell"].to_numpy(np.int64).view(np.uint64).tolist() == sorted(own["cell"].to_numpy(np.int64).view(np.uint64).tolist())


def test_s2_blocks_of_a_large_fence(spark):
    """More than 100,000 cells: every point of the fence lies in one of its blocks."""
    got = bootstrap.by_s2(_edges(spark, {7: [np.array([[-74.0, 40.0], [-72.6, 40.0], [-72.6, 41.1], [-74.0, 41.1]])]}), 15, 1).toPandas()
    rng = np.random.default_rng(5)
    inside = s2.cell_ids(40.0 + rng.random(20_000) * 1.1, -74.0 + rng.random(20_000) * 1.4, 15)
    assert len(got) > 100_000 and pd.Series(inside).isin(got["cell"]).all()


def test_s2_candidates_of_wide_bounds():
    """Points whose bounds hold more than 100,000 level-16 cells: candidates as from all those cells."""
    rng = np.random.default_rng(6)
    lat, lon = 40.0 + rng.random(40) * 0.5, -74.0 + rng.random(40) * 0.6
    front = s2.cover_rect(lat.min(), lon.min(), lat.max(), lon.max(), 16)
    assert len(front) > 100_000
    for level in range(16, 22):
        if level < 21:
            front = front[np.diff(cover.disc_members(*s2.centers(front), lat, lon, 70.0)[0]) > 0]
        face, i, j, _ = s2.to_face_ij(front)
        half = 1 << (s2.MAX_LEVEL - level - 1)
        front = np.concatenate([s2.from_face_ij(face, i + a * half, j + b * half, level + 1) for a in (0, 1) for b in (0, 1)])
    y, x = cover.s2_candidates(lat, lon, 70.0)
    want = s2.centers(front)
    assert (y == want[0]).all() and (x == want[1]).all()


def test_candidates_of_whole_fences(spark):
    """Candidates near all points of all fences, the grid as dense as the mode's, at the points' order."""
    points = pip_join(fixtures.view(spark, SF, "spawnpoint"), fixtures.view(spark, SF, "edge"), ["lat", "lon"]).toPandas().sort_values(["lat", "lon"])
    grid = {r.fid: r.n for r in QUERIES["q_cand_grid"](spark, SF).groupBy("fid").agg(F.count("*").alias("n")).collect()}
    assert set(grid) == set(points["fid"]) and set(grid.values()) == {cover.DENSITY["fast"] ** 2}
    got = QUERIES["q_cand_s2"](spark, SF).toPandas()
    for fid, p in points.groupby("fid"):
        y, x = cover.s2_candidates(p["lat"].to_numpy(), p["lon"].to_numpy(), 70.0)
        own = got[got["fid"] == fid].sort_values("cid")
        assert (own["lat"].to_numpy() == y).all() and (own["lon"].to_numpy() == x).all()


def test_scans_return_all_rows(spark):
    rows = spark.range(2_000_100).select("id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(9).alias("last_seen"), F.lit(1).alias("despawn_sec"))
    assert scans.spawnpoints(rows, 1).count() == scans.spawnpoints(rows, 1, bounds=(0, 0, 3, 3)).count() == 2_000_100
    assert [r.id for r in scans.spawnpoints(rows, 1, limit=3).collect()] == [0, 1, 2]
