"""S2 neighbours over the edges and corners of the cube, against cells that share corners, searched for among all cells near."""

import numpy as np
import pytest

from terracover.functions import s2

#: On a face, on its side edges (45 degrees of longitude), on its top edge, beyond it, and at corners where three faces meet.
PLACES = [(10, 40), (44.9999, 0.0), (45.0001, 0.0), (10, 44.9999), (10, 45.0001), (-20, 135), (-45.0002, 100), (35.26438, 44.9999), (35.2644, 45.0001), (-35.26438, -134.9999), (89.9, 10), (-89.99, 170)]


def near(lat, lon, level, reach):
    """All cells of a level within a few cells of a place, by a fine grid of points over the sphere's tangent plane."""
    p, q = np.radians(lat), np.radians(lon)
    c = np.array([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])
    e = np.array([-np.sin(q), np.cos(q), 0])
    n = np.cross(c, e)
    step = 2.0**-level * 0.3
    t = np.arange(-6 * reach - 12, 6 * reach + 13) * step
    xyz = c + t[:, None, None] * e + t[None, :, None] * n
    x, y, z = xyz.reshape(-1, 3).T
    return np.unique(s2.cell_ids(np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x)), level))


def spots(ids):
    """Corners of cells as keys."""
    v = np.radians(s2.vertices(ids))
    xyz = np.stack([np.cos(v[..., 0]) * np.cos(v[..., 1]), np.cos(v[..., 0]) * np.sin(v[..., 1]), np.sin(v[..., 0])], axis=-1)
    return [{tuple(p) for p in cell} for cell in np.round(xyz * 1e9).astype(np.int64).tolist()]


@pytest.mark.parametrize("place", PLACES)
def test_neighbours_share_corners(place):
    own = s2.cell_ids(np.array([place[0]]), np.array([place[1]]), 12)
    around = near(*place, 12, 2)
    keys = dict(zip(around.tolist(), spots(around)))
    mine = keys[int(own[0])]
    sharing = {c: len(k & mine) for c, k in keys.items() if c != int(own[0])}
    assert set(s2.all_neighbours(own).tolist()) == {c for c, n in sharing.items() if n}
    assert set(s2.edge_neighbours(own).tolist()) == {c for c, n in sharing.items() if n == 2}


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("size", [3, 5, 9])
def test_blocks_are_steps(place, size):
    own = int(s2.cell_ids(np.array([place[0]]), np.array([place[1]]), 12)[0])
    around = near(*place, 12, size)
    keys = dict(zip(around.tolist(), spots(around)))
    at = {}
    for c, k in keys.items():
        for p in k:
            at.setdefault(p, set()).add(c)
    seen = {own}
    for _ in range(size // 2):
        seen |= {c for s in seen for p in keys[s] for c in at[p]}
    got = s2.neighbourhood(own, size)
    assert set(got.tolist()) == seen and len(got) == len(seen)
    corner = 35 < abs(place[0]) < 36
    assert len(got) == size * size or corner and len(got) < size * size


@pytest.mark.parametrize("place", [(44.9999, 0.0), (10, 44.9999), (10, 40), (35.2643, 44.9998)])
def test_circle_is_all_cells_that_meet_it(place):
    got = set(s2.circle_cover(*place, 500.0, 15).tolist())
    ring = np.arange(60) * np.pi / 30
    d = 500.0 / s2.MEAN_RADIUS
    p, q = np.radians(place[0]), np.radians(place[1])
    lat = np.arcsin(np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(ring))
    lon = q + np.arctan2(np.sin(ring) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * np.sin(lat))
    poly = np.degrees(np.stack([lat, lon], axis=1))
    around = near(*place, 15, 6)
    want = {int(c) for c, v in zip(around, s2.vertices(around)) if s2.polygons_meet(v, poly)}
    assert got == want


def test_boxes_over_an_edge():
    """A box over the top edge of a face: cells of both faces, and all that meet it."""
    got = s2.cover_rect(44.95, -0.05, 45.05, 0.05, 13)
    v = s2.vertices(near(45.0, 0.0, 13, 12))
    all_near = near(45.0, 0.0, 13, 12)
    meets = (v[:, :, 0].max(1) >= 44.95) & (v[:, :, 0].min(1) <= 45.05) & (v[:, :, 1].max(1) >= -0.05) & (v[:, :, 1].min(1) <= 0.05)
    assert set(got.tolist()) == set(all_near[meets].tolist()) and len(set(s2.to_face_ij(got)[0].tolist())) == 2
