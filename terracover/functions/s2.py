"""S2 cells: vectorised kernel on numpy arrays and the column functions over it.

Ids are 64-bit patterns in signed longs; `unsigned` gives their decimal text and `order_key` a long
that sorts like the unsigned id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 30
MEAN_RADIUS = 6_371_008.8
SIZE = 1 << MAX_LEVEL

# The Hilbert curve's visiting order per orientation (bit 0: swap, bit 1: invert) and how
# each visited quadrant changes the orientation.
POS_TO_IJ = np.array([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]])
POS_TO_ORIENTATION = np.array([1, 0, 0, 3])
IJ_TO_POS = np.argsort(POS_TO_IJ, axis=1)


def _xyz(lat, lon):
    p, q = np.radians(lat), np.radians(lon)
    return np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)


def _face_uv(x, y, z):
    axis = np.argmax(np.abs(np.stack([x, y, z])), axis=0)
    main = np.choose(axis, [x, y, z])
    face = np.where(main < 0, axis + 3, axis)
    u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z], mode="raise")
    v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z], mode="raise")
    return face, u, v


def _uv_to_st(u):
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def _st_to_uv(s):
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)


def _face_xyz(face, u, v):
    one = np.ones_like(u)
    return (
        np.choose(face, [one, -u, -u, -one, v, v]),
        np.choose(face, [u, one, -v, -v, -one, u]),
        np.choose(face, [v, v, one, -u, -u, -one]),
    )


def from_face_ij(face, i, j, level: int = MAX_LEVEL) -> np.ndarray:
    """Ids of the cells of a level that hold the leaf coordinates (face, i, j)."""
    face, i, j = (np.asarray(a, np.int64) for a in (face, i, j))
    orient = face & 1
    pos = np.zeros_like(face)
    for k in range(MAX_LEVEL - 1, MAX_LEVEL - 1 - level, -1):
        quad = ((i >> k) & 1) << 1 | ((j >> k) & 1)
        step = IJ_TO_POS[orient, quad]
        pos = pos << 2 | step
        orient = orient ^ POS_TO_ORIENTATION[step]
    shift = 2 * (MAX_LEVEL - level)
    ids = (face.astype(np.uint64) << np.uint64(61)) | (pos.astype(np.uint64) << np.uint64(shift + 1)) | (np.uint64(1) << np.uint64(shift))
    return ids.view(np.int64)


def leaf_ij(lat, lon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, i, j) of the leaf that holds each point."""
    with np.errstate(divide="ignore", invalid="ignore"):
        face, u, v = _face_uv(*_xyz(np.asarray(lat, float), np.asarray(lon, float)))
    i, j = (np.clip(np.floor(_uv_to_st(a) * SIZE), 0, SIZE - 1).astype(np.int64) for a in (u, v))
    return face, i, j


def cell_ids(lat, lon, level: int = MAX_LEVEL) -> np.ndarray:
    """The cell of a level that holds each point."""
    return from_face_ij(*leaf_ij(lat, lon), level)


def lsb(ids) -> np.ndarray:
    u = np.asarray(ids, np.int64).view(np.uint64)
    return u & (~u + np.uint64(1))


def level_of(ids) -> np.ndarray:
    return MAX_LEVEL - (np.round(np.log2(lsb(ids).astype(float))).astype(np.int64) >> 1)


def parent(ids, level: int) -> np.ndarray:
    u = np.asarray(ids, np.int64).view(np.uint64)
    bit = np.uint64(1) << np.uint64(2 * (MAX_LEVEL - level))
    return ((u & (~bit + np.uint64(1))) | bit).view(np.int64)


def to_face_ij(ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """face, i, j (least leaf coordinates of the cell) and level."""
    u = np.asarray(ids, np.int64).view(np.uint64)
    level = level_of(ids)
    face = (u >> np.uint64(61)).astype(np.int64)
    orient, i, j = face & 1, np.zeros_like(face), np.zeros_like(face)
    for k in range(MAX_LEVEL - 1, -1, -1):
        step = ((u >> np.uint64(2 * k + 1)) & np.uint64(3)).astype(np.int64)
        live = k >= MAX_LEVEL - level
        quad = POS_TO_IJ[orient, step]
        i = np.where(live, i | (quad >> 1) << k, i)
        j = np.where(live, j | (quad & 1) << k, j)
        orient = np.where(live, orient ^ POS_TO_ORIENTATION[step], orient)
    return face, i, j, level


def _lat_lon(face, s, t):
    x, y, z = _face_xyz(face, _st_to_uv(s), _st_to_uv(t))
    return np.degrees(np.arctan2(z, np.hypot(x, y))), np.degrees(np.arctan2(y, x))


def centers(ids) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of the cells' centres."""
    face, i, j, level = to_face_ij(ids)
    half = np.ldexp(1.0, -level.astype(int) - 1)
    return _lat_lon(face, i / SIZE + half, j / SIZE + half)


def centers_at(face, i, j, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of cells of one level that are given by their least leaf coordinates."""
    half = np.ldexp(1.0, -level - 1)
    return _lat_lon(face, i / SIZE + half, j / SIZE + half)


def vertices(ids) -> np.ndarray:
    """(n, 4, 2) corners as [lat, lon], counter-clockwise."""
    face, i, j, level = to_face_ij(ids)
    side = np.ldexp(1.0, -level.astype(int))
    corners = [_lat_lon(face, i / SIZE + a * side, j / SIZE + b * side) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    return np.stack([np.stack(c, axis=1) for c in corners], axis=1)


def wrapped(face, i, j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, i, j) of leaf coordinates that may lie outside their face: those go over its edge to the leaf next to it.

    A coordinate outside is taken just beyond the edge, put on the cube's side and projected onto the face that
    it lies on; at a corner, where no leaf is diagonally opposite, that is one of the leaves around the corner.
    """
    face, i, j = np.broadcast_arrays(*(np.asarray(a, np.int64) for a in (face, i, j)))
    out = (i < 0) | (i >= SIZE) | (j < 0) | (j >= SIZE)
    if not out.any():
        return face, i, j
    beyond = np.nextafter(1.0, 2.0)
    u, v = (np.clip((2.0 * (np.clip(a[out], -1, SIZE) - SIZE // 2) + 1) / SIZE, -beyond, beyond) for a in (i, j))
    with np.errstate(divide="ignore", invalid="ignore"):
        other, u, v = _face_uv(*_face_xyz(face[out], u, v))
    face, i, j = face.copy(), i.copy(), j.copy()
    face[out] = other
    i[out], j[out] = (np.clip(np.floor((a + 1) / 2 * SIZE), 0, SIZE - 1).astype(np.int64) for a in (u, v))
    return face, i, j


#: Steps to the neighbours over an edge, and to those at a corner.
EDGE_STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))
CORNER_STEPS = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def _stepped(ids: np.ndarray, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Cells of the same levels that the steps lead to, over face edges too, each once."""
    ids = np.asarray(ids, np.int64)
    if not len(ids):
        return ids
    face, i, j, level = to_face_ij(ids)
    side = np.left_shift(1, MAX_LEVEL - level)
    out = []
    for a, b in steps:
        f, ii, jj = wrapped(face, i + a * side, j + b * side)
        for lv in np.unique(level):
            m = level == lv
            out.append(from_face_ij(f[m], ii[m], jj[m], int(lv)))
    return np.unique(np.concatenate(out))


def edge_neighbours(ids: np.ndarray) -> np.ndarray:
    """The four neighbours of each cell over its edges."""
    return _stepped(ids, EDGE_STEPS)


def all_neighbours(ids: np.ndarray) -> np.ndarray:
    """The neighbours of each cell over its edges and corners: eight, or seven at a corner of the cube."""
    return _stepped(ids, EDGE_STEPS + CORNER_STEPS)


def neighbourhood(cell: int, size: int) -> np.ndarray:
    """The cells of one level within size // 2 steps, diagonal ones too, of a cell: a block of size x size (size odd).

    Blocks go over the edges of the cube's faces; around its corners, where three cells meet, they have fewer cells.
    """
    return neighbourhoods(np.array([cell], np.int64), size)[0]


def neighbourhoods(cells: np.ndarray, size: int) -> list[np.ndarray]:
    """The neighbourhood of each cell: those inside a face as a block of coordinates, the others ring by ring."""
    cells = np.asarray(cells, np.int64)
    face, i, j, level = to_face_ij(cells)
    side, half = np.left_shift(1, MAX_LEVEL - level), size // 2
    low, high = np.minimum(i, j) - half * side, np.maximum(i, j) + half * side
    within = (low >= 0) & (high < SIZE)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(cells)
    di, dj = (a.ravel() for a in np.meshgrid(np.arange(-half, half + 1), np.arange(-half, half + 1), indexing="ij"))
    for lv in np.unique(level[within]):
        at = np.flatnonzero(within & (level == lv))
        ii, jj = (c[at, None] + d[None] * side[at, None] for c, d in ((i, di), (j, dj)))
        found = from_face_ij(np.repeat(face[at], len(di)), ii.ravel(), jj.ravel(), int(lv)).reshape(len(at), -1)
        for k, ids in zip(at.tolist(), found, strict=True):
            out[k] = ids
    for k in np.flatnonzero(~within).tolist():
        seen = front = cells[k : k + 1]
        for _ in range(half):
            front = np.setdiff1d(all_neighbours(front), seen)
            seen = np.union1d(seen, front)
        out[k] = seen
    return out


def cover_rect(min_lat: float, min_lon: float, max_lat: float, max_lon: float, level: int, limit: int | None = None) -> np.ndarray:
    """Cells of a level that meet a latitude-longitude rectangle, in unsigned order; a display list asks for at most `limit`.

    A flood fill over cells whose bounds meet the rectangle, started at its centre and corners.
    """
    lat = np.array([(min_lat + max_lat) / 2, min_lat, min_lat, max_lat, max_lat])
    lon = np.array([(min_lon + max_lon) / 2, min_lon, max_lon, min_lon, max_lon])
    front = np.unique(cell_ids(lat, lon, level))
    seen = front
    while len(front) and (limit is None or len(seen) < limit):
        nxt = np.setdiff1d(edge_neighbours(front), seen)
        if not len(nxt):
            break
        v = vertices(nxt)
        meets = (v[:, :, 0].max(1) >= min_lat) & (v[:, :, 0].min(1) <= max_lat) & (v[:, :, 1].max(1) >= min_lon) & (v[:, :, 1].min(1) <= max_lon)
        front = nxt[meets]
        seen = np.union1d(seen, front)
    return seen[np.argsort(seen.view(np.uint64))][:limit]


def cells_near(lat: np.ndarray, lon: np.ndarray, metres: float, level: int) -> np.ndarray:
    """Cells of a level that hold a probe around any point: all whose centre is within a distance of one are among them."""
    step = np.degrees(0.9 * 2**-level)  # below the least width of a cell, so that one of the probes falls in it
    reach = np.degrees(metres / MEAN_RADIUS)
    n = int(np.ceil(2 * reach / step)) + 2
    y = (np.arange(-n, n + 1) * step / 2)[:, None]
    rows = []
    for dy in y:
        p = np.clip(lat + dy, -90, 90)
        wide = 1 / np.maximum(np.cos(np.radians(np.minimum(np.abs(lat) + n * step / 2, 89.9))), 1e-9)
        rows += [np.unique(cell_ids(p, (lon + dx * wide + 180) % 360 - 180, level)) for dx in y[:, 0]]
    cells = np.unique(np.concatenate(rows))
    return cells[np.argsort(cells.view(np.uint64))]


def circle_cover(lat: float, lon: float, metres: float, level: int) -> np.ndarray:
    """The cell of a point and all cells reached over edges that meet the circle around it."""
    front = cell_ids(np.array([lat]), np.array([lon]), level)
    seen = front
    reach = metres / MEAN_RADIUS
    ring = np.arange(60) * (2 * np.pi / 60)
    p, q, d = np.radians(lat), np.radians(lon), reach
    rp = np.arcsin(np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(ring))
    rq = q + np.arctan2(np.sin(ring) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * np.sin(rp))
    poly = np.stack([np.degrees(rp), np.degrees(rq)], axis=1)
    while len(front):
        nxt = np.setdiff1d(edge_neighbours(front), seen)
        front = nxt[[polygons_meet(v, poly) for v in vertices(nxt)]] if len(nxt) else nxt
        seen = np.union1d(seen, front)
    return seen[np.argsort(seen.view(np.uint64))]


def circle_covers(lat: np.ndarray, lon: np.ndarray, metres: float, level: int, chunk: int = 2048) -> list[np.ndarray]:
    """circle_cover of each point, all circles a ring of cells further at once; nothing where a coordinate is missing."""
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    own = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
    ring = np.arange(60) * (2 * np.pi / 60)
    p, q, d = np.radians(lat)[:, None], np.radians(lon)[:, None], metres / MEAN_RADIUS
    rp = np.arcsin(np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(ring))
    rq = q + np.arctan2(np.sin(ring) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * np.sin(rp))
    poly = np.stack([np.degrees(rp), np.degrees(rq)], axis=2)
    cells = cell_ids(lat[own], lon[own], level)
    seen_own, seen = own, cells
    while len(own):
        ids, at = np.unique(cells, return_inverse=True)
        face, i, j, _ = to_face_ij(ids)
        side = 1 << (MAX_LEVEL - level)
        near = np.stack([from_face_ij(*wrapped(face, i + a * side, j + b * side), level) for a, b in EDGE_STEPS])
        nxt_own, nxt = np.tile(own, 4), near[:, at].ravel()
        ids = np.unique(np.concatenate([seen, nxt]))
        code = lambda o, c: o * len(ids) + np.searchsorted(ids, c)  # noqa: E731, B023
        fresh = np.setdiff1d(code(nxt_own, nxt), code(seen_own, seen))
        own, cells = fresh // len(ids), ids[fresh % len(ids)]
        v = vertices(cells) if len(cells) else np.zeros((0, 4, 2))
        parts = [_meet(v[k : k + chunk], poly[own[k : k + chunk]]) for k in range(0, len(own), chunk)]
        meets = np.concatenate(parts) if parts else np.zeros(0, bool)
        own, cells = own[meets], cells[meets]
        seen_own, seen = np.concatenate([seen_own, own]), np.concatenate([seen, cells])
    order = np.lexsort((seen.view(np.uint64), seen_own))
    return np.split(seen[order], np.cumsum(np.bincount(seen_own, minlength=len(lat)))[:-1]) if len(lat) else []


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """polygons_meet of each a with the b beside it."""
    p, r = a[:, :, None], (np.roll(a, -1, axis=1) - a)[:, :, None]
    q, s = b[:, None], (np.roll(b, -1, axis=1) - b)[:, None]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    d = cross(r, s)

    def holds(ring: np.ndarray, point: np.ndarray) -> np.ndarray:
        y, x, other = point[:, 0, None], point[:, 1, None], np.roll(ring, -1, axis=1)
        y1, x1, y2, x2 = ring[..., 0], ring[..., 1], other[..., 0], other[..., 1]
        return (((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum(axis=1) % 2 == 1

    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(q - p, s) / d, cross(q - p, r) / d
        touch = ((d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any(axis=(1, 2))
        return touch | holds(b, a[:, 0]) | holds(a, b[:, 0])


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Ray parity of [lat, lon] points in one ring."""
    y, x = points[:, :1], points[:, 1:]
    y1, x1 = ring[:, 0], ring[:, 1]
    y2, x2 = np.roll(y1, -1), np.roll(x1, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return cross.sum(axis=1) % 2 == 1


def segments_cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any edge of ring a properly crosses or touches one of ring b."""
    p, r = a[:, None], (np.roll(a, -1, axis=0) - a)[:, None]
    q, s = b[None], (np.roll(b, -1, axis=0) - b)[None]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    d = cross(r, s)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(q - p, s) / d, cross(q - p, r) / d
    return bool(((d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any())


def polygons_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two rings of [lat, lon] points share area or boundary."""
    return segments_cross(a, b) or bool(inside(a[:1], b)[0]) or bool(inside(b[:1], a)[0])


def cell(lat: Column, lon: Column, level: int) -> Column:
    """The cell id of a level as a column."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(cell_ids(a.to_numpy(float), b.to_numpy(float), level))

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(lat, lon)


def parent_of(ids: Column, level: int) -> Column:
    """The ancestor at a level; bit arithmetic in the JVM."""
    bit = 1 << (2 * (MAX_LEVEL - level))
    return ids.bitwiseAND(F.lit(-bit)).bitwiseOR(F.lit(bit))


def order_key(ids: Column) -> Column:
    """Sorts like the unsigned id."""
    return ids.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned(ids: Column) -> Column:
    """Decimal text of the unsigned id."""
    return F.when(ids >= 0, ids.cast("string")).otherwise((ids.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"))


def center(ids: Column) -> Column:
    """struct<lat, lon> of the cells' centres."""

    def run(a: pd.Series) -> pd.DataFrame:
        lat, lon = centers(a.to_numpy(np.int64))
        return pd.DataFrame({"lat": lat, "lon": lon})

    run.__annotations__ = {"a": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lat double, lon double")(ids)


def corners(ids: Column) -> Column:
    """array<array<double>>: the four corners [lat, lon]."""

    def run(a: pd.Series) -> pd.Series:
        return pd.Series([[p.tolist() for p in v] for v in vertices(a.to_numpy(np.int64))], dtype=object)

    run.__annotations__ = {"a": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<array<double>>")(ids)


def cells_in_box(y0: Column, x0: Column, y1: Column, x1: Column, level: int) -> Column:
    """array<long>: the cells of a level that meet each latitude-longitude box."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([cover_rect(*box, level).tolist() for box in zip(a, b, c, d, strict=True)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "c": pd.Series, "d": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<long>")(y0, x0, y1, x1)


def cells_within(lat: Column, lon: Column, metres: float, level: int) -> Column:
    """array<long>: the cells of a level that meet the circle around each point."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        y, x = a.to_numpy(float), b.to_numpy(float)
        return pd.Series([c.tolist() for k in range(0, len(y), 1024) for c in circle_covers(y[k : k + 1024], x[k : k + 1024], metres, level)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<long>")(lat, lon)
