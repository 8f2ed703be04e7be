"""Whole-table orders in buckets, and the union of polygons as rows, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from terracover.operators import grouping, polygons, stats


def test_numbered(spark):
    rows = [(i, None if i % 97 == 0 else f"k{(i * 7919) % 1000:04d}") for i in range(3000)] + [(5000 + i, "hot") for i in range(1500)]
    df = spark.createDataFrame(rows, "bucket long, name string")
    got = grouping.numbered(df, "name", "n").collect()
    assert sorted(r.n for r in got) == list(range(len(rows)))
    by = [r.name or "" for r in sorted(got, key=lambda r: r.n)]
    assert by == sorted(x[1] or "" for x in rows) and {(r.bucket, r.name) for r in got} == set(rows)
    assert grouping.numbered(df.limit(0), "name", "n").count() == 0


def test_worst_in_order(spark):
    rng = np.random.default_rng(3)
    for low in (0, 40):
        sizes = rng.integers(low, 60, 700).tolist() if low == 0 else sorted(rng.integers(0, 60, 700).tolist())
        top, below = -1, []
        for n in sizes:
            if n < top:
                below.append(n)
            top = max(top, n)
        got = stats.worst(spark.createDataFrame(list(enumerate(sizes)), "cid long, n_all long"), "cid").first()
        assert tuple(got) == ((min(below), below.count(min(below))) if below else (0, 0))


def box(x, y, w, h=None):
    h = w if h is None else h
    return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)


def star(x, y, r, n, turn):
    a = np.arange(2 * n) * np.pi / n + turn
    return np.stack([x + r * (1 - 0.5 * (np.arange(2 * n) % 2)) * np.cos(a), y + r * (1 - 0.5 * (np.arange(2 * n) % 2)) * np.sin(a)], axis=1)


CASES = {
    1: [[box(0, 0, 1)], [box(0.5, 0.5, 1)]],
    2: [[box(0, 0, 1)], [box(1, 0, 1)]],
    3: [[box(0, 0, 3), box(1, 1, 1)[::-1]], [box(1.25, 1.25, 0.5)]],
    4: [[star(10, 50, 0.02, 7, 0.1)], [star(10.013, 50.007, 0.02, 9, 0.4)], [star(10.3, 50, 0.011, 5, 0.2)], [star(9.99, 49.99, 0.015, 6, 0.7), star(9.99, 49.99, 0.004, 3, 0.0)]],
    5: [[box(-70, 40, 5, 4)], [box(-66, 43, 0.001)], [box(-65.5, 43.5, 0.8)]],
}


def test_union_of_rows_is_the_plain_union(spark):
    rows = [(k, f, r, i, *map(float, p)) for k, polys in CASES.items() for f, rings in enumerate(polys) for r, ring in enumerate(rings) for i, p in enumerate(ring)]
    df = spark.createDataFrame(rows, "k long, fid long, ring int, seq int, ex1 double, ey1 double")
    shape = lambda rings: sorted((len(r), round(polygons.area(r), 9)) for r in rings)
    for drop in (False, True):
        got = polygons.union_by(df, "k", drop).toPandas()
        for k, polys in CASES.items():
            mine = [g.sort_values("seq")[["x", "y"]].to_numpy() for _, g in got[got["k"] == k].groupby("ring")]
            want = [r for r in polygons.union(polys) if not drop or polygons.area(r) > 0]
            assert shape(mine) == shape(want), k
    assert polygons.union_by(df.where(F.lit(False)), "k").count() == 0
