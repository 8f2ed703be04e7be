"""Fences that share area: Ls, nested ones, holes, equal and touching ones; against random polygons tested by a fine grid of points."""

import numpy as np

from terracover.operators import client, polygons


def rows(fid, *rings):
    return [(fid, k, i, *a, *b) for k, r in enumerate(rings) for i, (a, b) in enumerate(zip(r, r[1:] + r[:1], strict=True))]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


SCHEMA = "fid long, ring int, seq int, ex1 double, ey1 double, ex2 double, ey2 double"
L = [(0.0, 0.0), (0.04, 0.0), (0.04, 0.01), (0.01, 0.01), (0.01, 0.04), (0.0, 0.04)]


def test_known_pairs(spark):
    a = rows(1, L) + rows(2, box(0.1, 0.1, 0.2, 0.2), box(0.12, 0.12, 0.18, 0.18)) + rows(3, box(5.0, 5.0, 25.0, 25.0))
    b = (
        rows(10, box(0.02, 0.02, 0.03, 0.03)) + rows(11, box(0.005, 0.03, 0.02, 0.05)) + rows(12, L) + rows(13, box(0.04, 0.0, 0.05, 0.01)) + rows(14, box(-0.01, -0.01, 0.0, 0.0))
        + rows(20, box(0.13, 0.13, 0.17, 0.17)) + rows(21, box(0.12, 0.12, 0.18, 0.18)) + rows(22, box(0.11, 0.11, 0.115, 0.115)) + rows(23, box(0.0, 0.0, 1.0, 1.0))
        + rows(30, box(10.0, 10.0, 10.001, 10.001)) + rows(31, box(4.0, 4.0, 30.0, 30.0)) + rows(32, box(25.0, 5.0, 26.0, 25.0))
    )
    got = {tuple(r) for r in polygons.intersecting(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()}
    assert got == {(1, 11), (1, 12), (1, 23), (2, 22), (2, 23), (3, 30), (3, 31)}
    empty = spark.createDataFrame([], SCHEMA)
    assert polygons.intersecting(empty, spark.createDataFrame(b, SCHEMA)).count() == 0


def test_random_polygons(spark):
    """Stars of any turn; pairs whose common points a fine grid meets, or nearly misses, are judged by it."""
    rng = np.random.default_rng(8)

    def star(x, y, r):
        t = np.sort(rng.uniform(0, 2 * np.pi, 7))
        d = rng.uniform(0.3, 1, 7) * r
        return [(float(x + u * np.cos(w)), float(y + u * np.sin(w))) for u, w in zip(d, t)]

    one = {k: star(*rng.uniform(0, 0.1, 2), rng.uniform(0.005, 0.03)) for k in range(14)}
    two = {100 + k: star(*rng.uniform(0, 0.1, 2), rng.uniform(0.005, 0.03)) for k in range(14)}
    n = 700
    px, py = (g.ravel() for g in np.meshgrid(np.linspace(-0.03, 0.13, n), np.linspace(-0.03, 0.13, n)))

    def held(ring):
        x1, y1 = np.array(ring).T
        x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
        odd = np.zeros(len(px), bool)
        for a, b, c, d in zip(x1, y1, x2, y2):
            odd ^= ((b > py) != (d > py)) & (px < (c - a) * (py - b) / (d - b + 1e-300) + a)
        return odd

    inside = {k: held(r) for k, r in (one | two).items()}
    got = {tuple(r) for r in polygons.intersecting(*(spark.createDataFrame([x for k, r in t.items() for x in rows(k, r)], SCHEMA) for t in (one, two))).collect()}
    common = {(a, b): int((inside[a] & inside[b]).sum()) for a in one for b in two}
    assert {p for p, c in common.items() if c} <= got and len(got) > 10
    # what the grid misses must at least cross
    from terracover.functions import s2

    flip = lambda r: np.array(r)[:, ::-1]
    assert all(common[p] or s2.polygons_meet(flip(one[p[0]]), flip(two[p[1]])) for p in got)


def test_filter_keeps_selected(spark):
    shapes = spark.createDataFrame(rows(1, box(0.0, 0.0, 0.02, 0.02)) + rows(2, box(0.01, 0.01, 0.03, 0.03)) + rows(3, box(0.05, 0.05, 0.06, 0.06)), SCHEMA)
    one = shapes.where("fid = 1")
    assert {r.fid for r in client.filter_polygons(one, shapes).collect()} == {1, 2}
    assert {r.fid for r in client.filter_polygons(one, shapes, keep_inside=False).collect()} == {1, 3}
