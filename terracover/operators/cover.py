"""Covering points with discs of one radius: candidates, greedy cover, unit-disc cover, centring, S2 blocks.

Groups (a fence, or a split cell within it) are independent and run in one task each; a group is what
`split` makes it, so pick a split level at which a group's points and candidates fit in memory.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.functions import geo, s2
from terracover.operators.grouping import dealt, numbered, settled
from terracover.operators.joins import radius_join

IDENTITY_LEVEL = 20
DENSITY = {"fast": 512, "balanced": 1024}
GREEDY_MODES = ("fast", "balanced", "better", "best", "honeycomb")
#: Candidates that a group looks at together; only those with enough points, and one of each set of points, are kept.
CHUNK = 1 << 19


def metres_between(lat1, lon1, lat2, lon2) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.MEAN_RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def degrees_for(lat: float, metres: float) -> float:
    d = math.degrees(metres / geo.GRID_RADIUS)
    return max(d, d / math.cos(math.radians(lat)))


def grid_blocks(lat: np.ndarray, lon: np.ndarray, metres: float, n: int, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One jittered candidate per cell of an n x n grid over the points' bounds, rows by rows; one point if degenerate."""
    return _bounded_blocks((lat.min(), lat.max(), lon.min(), lon.max(), float(np.mean(lat))), metres, n, seed)


#: Rows of the grid of candidates that are made together.
GRID_ROWS = 256


def _bounded_blocks(bounds: tuple[float, ...], metres: float, n: int, seed: int = 42, begin: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """grid_blocks of points with bounds (least and greatest lat and lon, mean lat), those that begin at rows begin to end."""
    low, high, west, east, mean = bounds
    r = degrees_for(mean, metres)
    y0, y1, x0, x1 = low - r, high + r, west - r, east + r
    if low == high and west == east:
        if not begin:
            yield np.array([low]), np.array([west])
        return
    col = np.arange(n)
    for first in range(begin, n if end is None else end, GRID_ROWS):
        row = np.arange(first, min(first + GRID_ROWS, n))[:, None]
        u = np.random.default_rng([seed, first]).random((2, len(row), n))
        yield (y0 + (row + u[0]) * (y1 - y0) / n).ravel(), (x0 + (col + u[1]) * (x1 - x0) / n).ravel()


def grid_candidates(lat: np.ndarray, lon: np.ndarray, metres: float, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """All of grid_blocks at once."""
    return tuple(np.concatenate(x) for x in zip(*grid_blocks(lat, lon, metres, n, seed), strict=True))


def meeting_points(lat: np.ndarray, lon: np.ndarray, metres: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The points themselves and, for each two within two radii, the two places at one radius from both.

    Whatever a disc covers, one of these discs covers too: a disc can be moved, with all that it covers,
    until two of its points lie on its rim.
    """
    yield lat, lon
    where = np.unique(np.stack([lat, lon], axis=1), axis=0)
    y, x = where[:, 0], where[:, 1]
    rim = (2 * math.sin(metres * (1 - 1e-7) / geo.MEAN_RADIUS / 2)) ** 2  # squared chord
    step = max(1, CHUNK // 256)
    for a in range(0, len(y), step):
        ptr, other = disc_members(y[a : a + step], x[a : a + step], y, x, 2 * metres * (1 - 1e-7))
        own = np.repeat(np.arange(a, a + len(ptr) - 1), np.diff(ptr))
        own, other = own[other > own], other[other > own]
        for k in range(0, len(own), CHUNK):
            yield from _rim_places(_unit_vectors(y[own[k : k + CHUNK]], x[own[k : k + CHUNK]]), _unit_vectors(y[other[k : k + CHUNK]], x[other[k : k + CHUNK]]), rim)[0]


def _rim_places(p: np.ndarray, q: np.ndarray, rim: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The two places at a squared chord `rim` from both p and q, as two (lat, lon), and which pairs have them."""
    half = ((q - p) ** 2).sum(axis=1) / 4
    away = (rim - half - rim * rim / 4) / (1 - half)  # squared sine of the way from the middle to the meeting points
    ok = (away >= 0) & (half > 0)
    mid, side, away = (p + q)[ok], np.cross(p, q)[ok], away[ok, None]
    mid, side = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (mid, side))
    out = []
    for sign in (1, -1):
        v = mid * np.sqrt(1 - away) + sign * np.sqrt(away) * side
        out.append((np.degrees(np.arctan2(v[:, 2], np.hypot(v[:, 0], v[:, 1]))), np.degrees(np.arctan2(v[:, 1], v[:, 0]))))
    return out, ok


def _unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=-1)


def _s2_front(lat: np.ndarray, lon: np.ndarray, metres: float) -> np.ndarray:
    """The level-16 cells of the bounds that a point is near to, and some more; from one point of each identity cell."""
    _, first = np.unique(s2.cell_ids(lat, lon, IDENTITY_LEVEL), return_index=True)
    front = s2.cells_near(lat[first], lon[first], metres + 15.0, 16)  # no such cell is wider
    v = s2.vertices(front)
    return front[(v[:, :, 0].max(1) >= lat.min()) & (v[:, :, 0].min(1) <= lat.max()) & (v[:, :, 1].max(1) >= lon.min()) & (v[:, :, 1].min(1) <= lon.max())]


def _near(lat: np.ndarray, lon: np.ndarray, metres: float):
    """Which of some centres have a point within reach, as a function of them."""
    raster = Raster.of(lat, lon, metres)
    raster = raster and raster.exposed()

    def near(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        if raster is None:
            return np.diff(disc_members(y, x, lat, lon, metres)[0]) > 0
        out = np.zeros(len(y), bool)
        for k, _, _, maps, _ in raster.discs(y, x, counted=False):
            out[k] = maps.any(axis=1)
        return out

    return near


def _s2_below(front: np.ndarray, reached) -> tuple[np.ndarray, np.ndarray]:
    face, i, j, _ = s2.to_face_ij(front)
    for level in range(16, 22):
        if level < 21:
            near = reached(*s2.centers_at(face, i, j, level))
            face, i, j = face[near], i[near], j[near]
        half = 1 << (s2.MAX_LEVEL - level - 1)
        face = np.tile(face, 4)
        i, j = (np.concatenate([x + k * half for k in steps]) for x, steps in ((i, (0, 0, 1, 1)), (j, (0, 1, 0, 1))))
    return s2.centers_at(face, i, j, 22)


def s2_candidates(lat: np.ndarray, lon: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """Level-22 centres below the level-16 cells of the bounds whose centres stay within reach of a point."""
    return _s2_below(_s2_front(lat, lon, metres), _near(lat, lon, metres))


def s2_blocks(lat: np.ndarray, lon: np.ndarray, metres: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, some level-16 cells (of 4,096 candidates each) at a time."""
    front, reached = _s2_front(lat, lon, metres), _near(lat, lon, metres)
    for k in range(0, len(front), CHUNK >> 12):
        yield _s2_below(front[k : k + (CHUNK >> 12)], reached)


def candidates(lat: np.ndarray, lon: np.ndarray, metres: float, mode: str, density: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The mode's candidates in blocks: a jittered grid (fast, balanced), S2 centres (better), with the meeting points of
    the points' rims (best), or the tiles of the points' bounds (honeycomb)."""
    if mode in DENSITY:
        yield from grid_blocks(lat, lon, metres, density or DENSITY[mode])
    elif mode == "honeycomb":
        p = lattice(lon.min(), lat.min(), lon.max(), lat.max(), metres)
        yield p[:, 0], p[:, 1]
    else:
        yield from s2_blocks(lat, lon, metres)
        if mode == "best":
            yield from meeting_points(lat, lon, metres)


def _kept(blocks: Iterator[tuple[np.ndarray, np.ndarray]], lat: np.ndarray, lon: np.ndarray, metres: float, least: int) -> tuple[np.ndarray, ...]:
    """lat, lon, offsets and members of the candidates with at least `least` points, the first of each set of points."""
    mark = np.random.default_rng(7).integers(1, 1 << 63, len(lat), dtype=np.uint64)
    seen = np.zeros(0, np.uint64)
    ys, xs, sizes, members = [], [], [], []
    for y, x in blocks:
        ptr, own = disc_members(y, x, lat, lon, metres)
        n = np.diff(ptr)
        good = np.flatnonzero(n >= least)
        if not len(good):
            continue
        sums = np.r_[np.uint64(0), np.cumsum(mark[own])]
        sign = sums[ptr[good + 1]] - sums[ptr[good]]
        _, first = np.unique(sign, return_index=True)
        first = np.sort(first[~np.isin(sign[first], seen)])
        good = good[first]
        seen = np.r_[seen, sign[first]]
        where, _ = _gather(ptr, good)
        ys.append(y[good])
        xs.append(x[good])
        sizes.append(n[good])
        members.append(own[where])
    if not ys:
        return np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ys), np.concatenate(xs), np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(members)


def forward(lat: float, lon: float, bearing: float, metres: float) -> tuple[float, float]:
    d, b, p = metres / geo.MEAN_RADIUS, math.radians(bearing), math.radians(lat)
    q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(b))
    e = math.atan2(math.sin(b) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
    return math.degrees(q), lon + math.degrees(e)


def lattice(x0: float, y0: float, x1: float, y1: float, metres: float) -> np.ndarray:
    """A serpentine hexagonal walk over the bounds from the north-east corner, as [lat, lon]."""
    step, down, shift = math.sqrt(0.75) * 2 * metres, math.sqrt(0.568) * 2 * metres, math.sqrt(0.75) * 3 * metres
    out, lat, lon, bearing, row = [], y1, x1, 270.0, 0
    low, _ = forward(y0, x0, 180, metres)
    while lat > low:
        while (lon > x0) if bearing == 270 else (lon < x1):
            out.append((lat, lon))
            lat, lon = forward(lat, lon, bearing, step)
        out.append((lat, lon))
        lat, lon = forward(lat, lon, 180, down)
        bearing = 90.0 if bearing == 270 else 270.0
        lat, lon = forward(lat, lon, bearing, shift if row % 2 == 0 else shift / 3)
        row += 1
    return np.array(out).reshape(-1, 2)


def disc_members(c_lat, c_lon, p_lat, p_lon, metres: float, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Members of each disc as (offsets, point indices): bucketed search by chords, rechecked near the rim by great circles.

    Buckets wrap around at 180 degrees; near a pole the search runs over all longitudes.
    """
    step = math.degrees(metres / geo.GRID_RADIUS) * 1.001
    top = min(89.0, max(np.abs(p_lat).max(initial=0), np.abs(c_lat).max(initial=0)) + step)
    wide = 360.0 / max(1, math.floor(360.0 * math.cos(math.radians(top)) / step)) if top < 89.0 else 360.0
    turns = round(360.0 / wide)
    slot = lambda lon: np.floor((lon % 360.0) / wide).astype(np.int64) % turns
    key = np.floor(p_lat / step).astype(np.int64) * (1 << 32) + slot(p_lon)
    order = np.argsort(key, kind="stable")
    key = key[order]
    cy, cx = np.floor(c_lat / step).astype(np.int64), slot(c_lon)
    # in each band the slots next to the centre's, as one range of keys, or two where they wrap
    near = min(turns, 3)
    first = (cx - 1) % turns if near == 3 else np.zeros_like(cx)
    ranges = []
    for dy in (-1, 0, 1):
        base = (cy + dy) * (1 << 32)
        ranges.append((np.searchsorted(key, base + first, "left"), np.searchsorted(key, base + np.minimum(first + near, turns), "left")))
        if near == 3 and turns > 3 and (first + 3 > turns).any():
            ranges.append((np.searchsorted(key, base, "left"), np.searchsorted(key, base + np.maximum(first + 3 - turns, 0), "left")))
        elif near == 3 and turns == 3:
            ranges[-1] = (np.searchsorted(key, base, "left"), np.searchsorted(key, base + turns, "left"))
    p, c = _unit_vectors(p_lat[order], p_lon[order]), _unit_vectors(c_lat, c_lon)
    rim = (2 * math.sin(min(metres / geo.MEAN_RADIUS, math.pi) / 2)) ** 2
    parts = []
    for lo, hi in ranges:
        size = hi - lo
        total = np.cumsum(size)
        cuts = np.searchsorted(total, np.arange(chunk, size.sum() + chunk, chunk)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(size)], strict=True):
            a, b = min(int(a), len(size)), min(int(b), len(size))
            n = size[a:b]
            if b <= a or not n.sum():
                continue
            own = np.repeat(np.arange(a, b), n)
            at = np.repeat(lo[a:b] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            d = c[own, 0] - p[at, 0]
            chord = d * d
            for k in (1, 2):
                d = c[own, k] - p[at, k]
                chord += d * d
            ok = chord <= rim
            close = np.flatnonzero(np.abs(chord - rim) <= rim * 1e-6 + 1e-30)
            if len(close):
                ok[close] = metres_between(c_lat[own[close]], c_lon[own[close]], p_lat[order[at[close]]], p_lon[order[at[close]]]) <= metres
            parts.append((own[ok], order[at[ok]]))
    own, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    by = np.argsort(own, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(own, minlength=len(c_lat)))], at[by]


def _gather(ptr: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the candidates' members, and where each candidate's begin in them."""
    n = ptr[c + 1] - ptr[c]
    start = np.cumsum(n) - n
    return np.repeat(ptr[c] - start, n) + np.arange(n.sum()), start


def greedy(ptr: np.ndarray, members: np.ndarray, identity: np.ndarray, min_points: int, max_clusters: int = 0, prune: bool = True) -> list[int]:
    """Candidates in the order of acceptance: most uncovered distinct points first, then most points.

    Residuals only fall, so a candidate is re-counted only when its last count is the current level, a
    block of candidates at a time; the first that still holds is accepted and blocks its points. Then
    discs with fewer than min_points points of their own are dropped.
    """
    least, raw = max(1, min_points), np.diff(ptr)
    own, distinct = identity[members], int(identity.max(initial=-1)) + 1
    if distinct < len(identity):  # a disc counts a repeated position once
        pairs = np.sort(np.repeat(np.arange(len(raw)), raw) * np.int64(distinct) + own)
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        own, ptr = pairs % distinct, np.r_[0, np.cumsum(np.bincount(pairs // distinct, minlength=len(raw)))]
    left = np.where(raw >= least, np.diff(ptr), 0)
    free = np.ones(distinct, bool)

    def count(block: np.ndarray) -> np.ndarray:
        where, start = _gather(ptr, block)
        return np.add.reduceat(free[own[where]], start, dtype=np.int64)

    def take(c: int) -> None:
        free[own[ptr[c] : ptr[c + 1]]] = False

    taken = _accepted(left, lambda block: raw[block], least, max_clusters, count, take)
    return _pruned(taken, ptr, own, np.arange(distinct), min_points) if prune else taken


def _accepted(left: np.ndarray, raw, least: int, max_clusters: int, count, take) -> list[int]:
    """The loop of `greedy` over residuals `left`, with count(block) of the points that are free, take(candidate) and raw(block), the
    number of points of candidates, which is asked for only where residuals are equal."""
    taken: list[int] = []
    level = int(left.max(initial=0))
    while level >= least and (not max_clusters or len(taken) < max_clusters):
        todo = np.flatnonzero(left == level)
        for k in range(0, len(todo), 8192):
            left[todo[k : k + 8192]] = count(todo[k : k + 8192])
        todo = todo[left[todo] == level]
        todo = todo[np.argsort(-raw(todo), kind="stable")] if len(todo) > 1 else todo
        at, size = 0, 64
        while at < len(todo) and (not max_clusters or len(taken) < max_clusters):
            block = todo[at : at + size]
            now = count(block)
            left[block] = now
            hold = np.flatnonzero(now == level)
            if len(hold):
                c = int(block[hold[0]])
                take(c)
                left[c] = 0
                taken.append(c)
                at, size = at + int(hold[0]) + 1, 64
            else:
                at, size = at + len(block), min(2 * size, 8192)
        level = min(level - 1, int(left.max(initial=0)))
    return taken


def _pruned(taken: list[int], ptr, members, identity, min_points: int) -> list[int]:
    """Without the discs that have fewer than min_points points which no other accepted disc covers."""
    own = [np.unique(identity[members[ptr[c] : ptr[c + 1]]]) for c in taken]
    if not own:
        return taken
    covers = np.bincount(np.concatenate(own), minlength=int(identity.max()) + 1)
    return [c for c, x in zip(taken, own, strict=True) if (covers[x] == 1).sum() >= min_points]


#: Metres from a cell's middle to its farthest corner at level 0, at most; cells that are looked at together, the level of the smallest,
#: and what is added to the level of those whose bound is reached.
HALF_CELL, CELLS, SMALLEST, SETTLED = 1.2195 * geo.MEAN_RADIUS, 512, 28, 32
#: Directions from a cell's middle for which its farthest point is kept.
DIRECTIONS = 32
#: Pairs of points within a radius, beyond which mode `best` makes no list of all meeting points.
PAIRS = 1 << 17


class _Nodes:
    """Cells of one level over points in leaf order: where their points and the next level's cells begin, a ball around each."""

    def __init__(self, cells: np.ndarray, p: np.ndarray, rim: float):
        self.first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        self.n = np.diff(np.r_[self.first, len(cells)])
        self.mid = np.add.reduceat(p, self.first, axis=0) / self.n[:, None]
        self.radius = np.sqrt(np.maximum.reduceat(((p - np.repeat(self.mid, self.n, axis=0)) ** 2).sum(axis=1), self.first)) + 1e-12
        self.reaching(rim)

    def reaching(self, rim: float) -> None:
        self.inner = np.where(self.radius < rim, (rim * (1 - 1e-6) - self.radius), -1.0)
        self.inner = np.where(self.inner > 0, self.inner**2, -1.0)
        self.outer = (rim * (1 + 1e-6) + self.radius) ** 2


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a[:, 0] - b[:, 0]) ** 2
    for k in (1, 2):
        out += (a[:, k] - b[:, k]) ** 2
    return out


def _ranges(first: np.ndarray, size: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges (first, size) written out as (range, position), some `limit` positions at a time."""
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        n = size[a:b]
        own = np.repeat(np.arange(a, b), n)
        yield own, np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(len(own))
        a = b


def _exposed(lat: np.ndarray, lon: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray]:
    """The points that decide where a disc reaches their identity cell: without those all of whose disc the discs of others in the cell cover.

    Another point at v covers of a point's rim the arc around v's direction up to arccos(|v| / 2 metres) to both sides.
    """
    lat, lon = np.unique(np.stack([lat, lon], axis=1), axis=0).T
    if metres < 30.0:  # a cell is not well within a disc
        return lat, lon
    for level in (IDENTITY_LEVEL + 2, IDENTITY_LEVEL):
        cells = s2.cell_ids(lat, lon, level)
        order = np.argsort(cells, kind="stable")
        cells, lat, lon = cells[order], lat[order], lon[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        size = np.diff(np.r_[first, len(cells)])
        out = np.ones(len(lat), bool)
        for own, at in _ranges(np.repeat(first, size), np.repeat(size, size)):
            own, at = own[own != at], at[own != at]
            if not len(own):
                continue
            scale = np.cos(np.radians(lat[own]))
            y, x = np.radians(lat[at] - lat[own]) * geo.MEAN_RADIUS, np.radians(lon[at] - lon[own]) * geo.MEAN_RADIUS * scale
            turn, arc = np.arctan2(y, x), np.arccos(np.minimum(1.0, np.hypot(x, y) / (2 * metres))) - 1e-5 / scale
            by = np.lexsort((turn, own))
            own, turn, arc = own[by], turn[by], arc[by]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            follow = np.arange(1, len(own) + 1)
            last = np.r_[start[1:], len(own)] - 1
            follow[last] = start
            gap = turn[follow] - turn
            gap[last] += 2 * math.pi
            out[own[start]] = ~np.logical_and.reduceat(gap < arc + arc[follow], start)
        lat, lon = lat[out], lon[out]
    return lat, lon


#: Level of the cells whose points are looked at together by `exposed`; identity cells are whole in it.
EXPOSED_LEVEL = 16


def exposed(points: DataFrame, metres: float) -> DataFrame:
    """(fid, lat, lon): of the points (fid, lat, lon) of each fence those that decide where a disc reaches one.

    Cells are looked at in tasks of their own; what remains of one grows with about the cube root of its points (with
    discs below 30 m, repeated places alone go).
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y, x = _exposed(g["lat"].to_numpy(float), g["lon"].to_numpy(float), metres)
        return pd.DataFrame({"fid": key[0], "lat": y, "lon": x})

    own = points.select(F.col("fid").cast("long").alias("fid"), "lat", "lon").where("lat is not null and lon is not null")
    own = own.withColumn("cell", s2.cell(F.col("lat"), F.col("lon"), EXPOSED_LEVEL))
    return dealt(own, "fid", "cell").groupBy("fid", "cell").applyInPandas(run, "fid long, lat double, lon double")


class Raster:
    """A group's points below their identity cells, for discs of many points.

    A disc is a bit map of the identity cells around its centre that it has a point in, and its number of
    points: a fixed size, however many points a cell has. Cells (and cells in them) that a disc holds
    whole or misses are settled by a ball around their points; only points of cells at the rim are looked at.
    """

    @staticmethod
    def of(lat: np.ndarray, lon: np.ndarray, metres: float, more: float = 0.0) -> Raster | None:
        """None where points are too sparse for it, discs too wide (by `more` metres too), or the cells not on one face of the cube."""
        reach = math.ceil((metres + more) * 1.001 / (0.9428 * geo.MEAN_RADIUS * 2.0**-IDENTITY_LEVEL)) + 1
        face, i, j = s2.leaf_ij(lat, lon)
        shift, size = s2.MAX_LEVEL - IDENTITY_LEVEL, 1 << IDENTITY_LEVEL
        box = [(int(a.min()) >> shift, int(a.max()) >> shift) for a in (i, j)]
        cells = math.prod(b - a + 1 for a, b in box)
        if 2 * reach + 1 > 52 or cells > 16 * len(lat) or (face != face[0]).any() or any(a < 4 * reach or b >= size - 4 * reach for a, b in box):
            return None
        return Raster(lat, lon, metres, reach, int(face[0]), [a - 2 * reach for a, _ in box], [b - a + 1 + 4 * reach for a, b in box])

    def __init__(self, lat: np.ndarray, lon: np.ndarray, metres: float, reach: int, face: int, corner: list[int], shape: list[int]):
        self.metres, self.reach, self.side, self.face, self.corner, self.shape = metres, reach, 2 * reach + 1, face, corner, shape
        self.kind = np.uint32 if self.side <= 32 else np.uint64
        self.rim = 2 * math.sin(min(metres / geo.MEAN_RADIUS, math.pi) / 2)
        leaves = s2.cell_ids(lat, lon)
        order = np.argsort(leaves, kind="stable")
        leaves, self.lat, self.lon = leaves[order], lat[order], lon[order]
        self.p = _unit_vectors(self.lat, self.lon)
        self.levels, level = [], IDENTITY_LEVEL
        while not self.levels or (level <= s2.MAX_LEVEL - 2 and len(lat) > 16 * len(self.levels[-1].n)):
            self.levels.append(_Nodes(s2.parent(leaves, level), self.p, self.rim))
            level += 2
        _, i, j = s2.leaf_ij(self.lat[self.levels[0].first], self.lon[self.levels[0].first])
        self.i, self.j = (((a >> (s2.MAX_LEVEL - IDENTITY_LEVEL)) - c).astype(np.int32) for a, c in zip((i, j), corner, strict=True))
        self.index = np.full(shape, -1, np.int32)
        self.index[self.i, self.j] = np.arange(len(self.i))
        self.table = None

    def _look(self, depth: int, c: np.ndarray, own: np.ndarray, at: np.ndarray, pair: np.ndarray, raw: np.ndarray, hit: np.ndarray) -> None:
        """Adds to raw[own] the points of a level's cells that lie in discs c[own], and marks the pairs that have any."""
        if depth == len(self.levels):
            chord = _square(c[own], self.p[at])
            ok, rim = chord <= self.rim**2, self.rim**2
            close = np.flatnonzero(np.abs(chord - rim) <= rim * 1e-6 + 1e-30)
            if len(close):
                y, x = self._centres
                ok[close] = metres_between(y[own[close]], x[own[close]], self.lat[at[close]], self.lon[at[close]]) <= self.metres
            raw += np.bincount(own[ok], minlength=len(raw))
            hit[pair[ok]] = True
            return
        level = self.levels[depth]
        away = _square(c[own], level.mid[at])
        whole = away <= level.inner[at]
        raw += np.bincount(own[whole], weights=level.n[at[whole]], minlength=len(raw)).astype(np.int64)
        hit[pair[whole]] = True
        rest = np.flatnonzero(~whole & (away <= level.outer[at]))
        first, size = level.first[at[rest]], level.n[at[rest]]
        if depth + 1 < len(self.levels):
            below = self.levels[depth + 1].first
            first, last = np.searchsorted(below, first), np.searchsorted(below, first + size)
            size = last - first
        for k, inner in _ranges(first, size):
            self._look(depth + 1, c, own[rest[k]], inner, pair[rest[k]], raw, hit)

    def _maps(self, own: np.ndarray, node: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Bit maps with corners (row, col) of pairs (own, node)."""
        at = own * self.side + self.i[node] - row[own]
        return np.bincount(at, weights=np.ldexp(1.0, self.j[node] - col[own]), minlength=len(row) * self.side).astype(self.kind).reshape(-1, self.side)

    def _supported(self) -> None:
        """For each cell and direction the point that lies farthest that way from the cell's middle, and how far any lies (see `_reached`)."""
        top = self.levels[0]
        axis = np.eye(3)[np.abs(top.mid).max(axis=0).argmin()]
        east = np.cross(axis, top.mid)
        east /= np.linalg.norm(east, axis=1, keepdims=True)
        north = np.cross(top.mid, east) / np.linalg.norm(top.mid, axis=1, keepdims=True)
        own = np.repeat(np.arange(len(top.n)), top.n)
        q = self.p - top.mid[own]
        x, y = (q * east[own]).sum(axis=1), (q * north[own]).sum(axis=1)
        turn, size, step = np.arctan2(y, x), np.hypot(x, y), 2 * math.pi / DIRECTIONS
        farthest, support = np.empty((len(top.n), DIRECTIONS), np.int32), np.empty((len(top.n), DIRECTIONS))
        for b in range(DIRECTIONS):
            off = np.abs((turn - (b + 0.5) * step + math.pi) % (2 * math.pi) - math.pi)
            along = size * np.cos(off)
            best = np.flatnonzero(along == np.maximum.reduceat(along, top.first)[own])[::-1]
            farthest[own[best], b] = best
            support[:, b] = np.maximum.reduceat(size * np.cos(np.maximum(0.0, off - step / 2)), top.first)
        self.table = east, north, farthest.ravel(), (support + 1e-3 * top.radius[:, None] + 1e-12).ravel()

    def _reached(self, c: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether discs c[own] have points of cells `at`.

        Of a cell the point farthest towards the disc mostly settles it, or that none lies farther that way; else all are looked at.
        """
        hit = np.zeros(len(own), bool)
        rest = np.arange(len(own))
        if self.table is not None:
            (east, north, farthest, support), top = self.table, self.levels[0]
            away = _square(c[own], top.mid[at])
            hit = away <= top.inner[at]
            rest = np.flatnonzero(~hit & (away <= top.outer[at]))
            o, a = own[rest], at[rest]
            d = c[o] - top.mid[a]
            x, y = np.einsum("ij,ij->i", d, east[a]), np.einsum("ij,ij->i", d, north[a])
            k = a * DIRECTIONS + np.minimum((np.arctan2(y, x) % (2 * math.pi) * (DIRECTIONS / (2 * math.pi))).astype(np.int64), DIRECTIONS - 1)
            near = np.sqrt(away[rest]) - support[k] <= self.rim * (1 + 1e-5)
            rest, k = rest[near], k[near]
            sure = _square(c[own[rest]], self.p[farthest[k]]) <= self.rim**2 * (1 - 2e-6)
            hit[rest[sure]] = True
            rest = rest[~sure]
        if len(rest):
            self._look(0, c, own[rest], at[rest], rest, np.zeros(len(c), np.int64), hit)
        return hit

    def discs(self, lat: np.ndarray, lon: np.ndarray, counted: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """(disc, row, col, map, points) of the discs with any points near, some at a time; points only where they are to be counted."""
        face, i, j = s2.leaf_ij(lat, lon)
        i, j = ((a >> (s2.MAX_LEVEL - IDENTITY_LEVEL)) - c for a, c in zip((i, j), self.corner, strict=True))
        r, top = self.reach, self.levels[0]
        ok = np.flatnonzero((face == self.face) & (i >= r) & (i < self.shape[0] - r) & (j >= r) & (j < self.shape[1] - r))
        ok = ok[np.argsort(i[ok] * self.shape[1] + j[ok], kind="stable")]
        window = np.arange(-r, r + 1)
        for a in range(0, len(ok), 8192):
            k = ok[a : a + 8192]
            y, x, ki, kj = lat[k], lon[k], i[k], j[k]
            c, self._centres = _unit_vectors(y, x), (y, x)
            # what all discs with their centres in one cell hold or miss
            first = np.flatnonzero(np.r_[True, (np.diff(ki) != 0) | (np.diff(kj) != 0)])
            n = np.diff(np.r_[first, len(k)])
            mid = np.add.reduceat(c, first, axis=0) / n[:, None]
            radius = np.sqrt(np.maximum.reduceat(_square(c, np.repeat(mid, n, axis=0)), first)) + 1e-12
            node = self.index[ki[first][:, None, None] + window[:, None], kj[first][:, None, None] + window].reshape(len(first), -1)
            cell, at = np.nonzero(node >= 0)
            node = node[cell, at]
            away = np.sqrt(_square(mid[cell], top.mid[node]))
            whole = away + radius[cell] + top.radius[node] <= self.rim * (1 - 1e-6)
            some = ~whole & (away - radius[cell] - top.radius[node] <= self.rim * (1 + 1e-6))
            row, col = ki - r, kj - r
            base = self._maps(cell[whole], node[whole], row[first], col[first])
            points = np.bincount(cell[whole], weights=top.n[node[whole]], minlength=len(first)).astype(np.int64)
            group = np.repeat(np.arange(len(first)), n)
            maps, raw = base[group], points[group]
            cell, node = cell[some], node[some]
            start = np.searchsorted(cell, np.arange(len(first) + 1))
            own, pos = (np.concatenate(v) for v in zip(*_ranges(start[group], np.diff(start)[group]), strict=True)) if len(cell) else (np.zeros(0, np.int64),) * 2
            hit = np.zeros(len(own), bool)
            for b in range(0, len(own), 1 << 20):
                part = slice(b, b + (1 << 20))
                if counted:
                    self._look(0, c, own[part], node[pos[part]], np.arange(len(own))[part], raw, hit)
                else:
                    hit[part] = self._reached(c, own[part], node[pos[part]])
            maps |= self._maps(own[hit], node[pos[hit]], row, col)
            yield k, row.astype(np.int32), col.astype(np.int32), maps, raw

    def greedy(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], least: int, min_points: int, max_clusters: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Centres of the candidates that `greedy` accepts, in its order.

        Which cells a disc reaches is up to few points of each cell. How many points a disc has decides only between
        candidates that cover as many free cells: all points are looked at for those alone.
        """
        kept, some = [], self.exposed()
        for y, x in blocks:
            parts = []
            for k, row, col, maps, _ in some.discs(y, x, counted=False):
                good = np.bitwise_count(maps).sum(axis=1, dtype=np.int64) >= least
                parts.append((k[good], row[good], col[good], maps[good]))
            if parts:
                k, *rest = (np.concatenate(v) for v in zip(*parts, strict=True))
                back = np.argsort(k)
                kept.append((y[k[back]], x[k[back]], *(v[back] for v in rest)))
        if not kept:
            return np.zeros(0), np.zeros(0)
        y, x, row, col, maps = (np.concatenate(v) for v in zip(*kept, strict=True))
        del kept
        left, free, points = np.bitwise_count(maps).sum(axis=1, dtype=np.int64), _Free(self), np.full(len(y), -1)

        def raw(block: np.ndarray) -> np.ndarray:
            new = block[points[block] < 0]
            for k, _, _, _, n in self.discs(y[new], x[new]):
                points[new[k]] = n
            return points[block]

        taken = _accepted(left, raw, least, max_clusters, lambda block: free.count(row[block], col[block], maps[block]), lambda c: free.take(int(row[c]), int(col[c]), maps[c]))
        taken = [c for c, own in zip(taken, free.own(), strict=True) if own >= min_points]
        return y[taken], x[taken]

    def exposed(self) -> Raster:
        """The same cells with only the points that decide where a disc reaches them."""
        out = Raster(*_exposed(self.lat, self.lon, self.metres), self.metres, self.reach, self.face, self.corner, self.shape)
        if len(out.lat) > 2 * len(out.i):
            out._supported()
        return out

    def within(self, metres: float) -> Raster:
        """The same points for discs of another radius, within what the raster was made for."""
        out = copy.copy(self)
        out.metres, out.rim = metres, 2 * math.sin(min(metres / geo.MEAN_RADIUS, math.pi) / 2)
        out.levels = [copy.copy(level) for level in self.levels]
        for level in out.levels:
            level.reaching(out.rim)
        return out

    def crowded(self, pairs: int) -> bool:
        """Whether more than some pairs of points are within a radius."""
        met = 0
        for part in self.discs(self.lat, self.lon):
            met += int(part[4].sum())
            if met > 2 * pairs:
                return True
        return False

    def widest(self, least: int, min_points: int, max_clusters: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Centres that each cover the most free cells of all places there are, one after the other.

        The map is a tree of cells. A cell's bound is what a disc wider by half its diagonal covers, and what is covered
        already only lowers it: those with the highest bound are looked at first, deepest first. Where the middle of one reaches
        the bound, no place anywhere covers more, and it is taken (of those looked at together, that with most points); else
        the cell is cut in four. Only points that decide where a cell is reached are looked at. Of the smallest cells the meeting points of rims inside are tried. Nothing holds all places.
        """
        full, free, views, found = self, _Free(self), {}, []
        self = full.exposed()
        # by bound and level: i, j, how many were taken by then, and bit maps: corners, what any and what every disc with its centre inside reaches
        queue: dict[int, dict[int, list[tuple[np.ndarray, ...]]]] = {}

        def put(level: int, bound: np.ndarray, rows: tuple[np.ndarray, ...]) -> None:
            for u in np.unique(bound[bound >= least]).tolist():
                k = bound == u
                queue.setdefault(u, {}).setdefault(level, []).append(tuple(v[k] for v in rows))

        def pulled(level: int, u: int, room: int) -> tuple[np.ndarray, ...]:
            rows = queue[u].pop(level)
            some = tuple(np.concatenate(v) for v in zip(*rows, strict=True))
            if len(some[0]) > room:
                queue[u][level] = [tuple(v[room:] for v in some)]
            if not queue[u]:
                del queue[u]
            return (*(v[:room] for v in some), np.full(min(room, len(some[0])), u))

        def counts(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            n = np.zeros(len(y), np.int64)
            for k, row, col, maps, _ in self.discs(y, x, counted=False):
                n[k] = free.count(row, col, maps)
            return n

        def view(level: int, sign: int) -> Raster | None:
            if (level, sign) not in views:
                metres = self.metres + sign * HALF_CELL / 2**level
                views[level, sign] = self.within(metres) if metres > 0 else None
            return views[level, sign]

        def unsure(row: np.ndarray, col: np.ndarray, up: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(own, node): the free cells that are in the first map and not in the second."""
            bits = up & ~low & free.packed[row[:, None] + free.steps, col[:, None]]
            own, a, b = np.nonzero(bits[:, :, None] >> free.bits & free.kind(1))
            return own, self.index[row[own] + a, col[own] + b]

        def reached(by: Raster | None, y: np.ndarray, x: np.ndarray, own: np.ndarray, node: np.ndarray, row: np.ndarray, col: np.ndarray, low: np.ndarray) -> np.ndarray:
            """The maps low with those of the pairs (own, node) that discs around places reach."""
            if by is None or not len(own):
                return low
            by._centres = y, x
            hit = by._reached(_unit_vectors(y, x), own, node)
            return low | by._maps(own[hit], node[hit], row, col)

        side, r = 1 << (s2.MAX_LEVEL - IDENTITY_LEVEL), self.reach
        i, j = (a.ravel() for a in np.meshgrid(*(np.arange(r, n - r) for n in self.shape), indexing="ij"))
        for a in range(0, len(i), 1 << 16):
            ii, jj = ((v[a : a + (1 << 16)] + c) * side for v, c in zip((i, j), self.corner, strict=True))
            y, x = s2.centers_at(np.full(len(ii), self.face), ii, jj, IDENTITY_LEVEL)
            for k, row, col, up, _ in view(IDENTITY_LEVEL, 1).discs(y, x, counted=False):
                low = np.zeros_like(up)
                low = reached(view(IDENTITY_LEVEL, -1), y[k], x[k], *unsure(row, col, up, low), row, col, low)
                put(IDENTITY_LEVEL, free.count(row, col, up), (ii[k], jj[k], np.zeros(len(k), np.int64), row, col, up, low))
        while queue and (not max_clusters or len(found) < max_clusters):
            top = max(queue)
            key, rows, room = max(queue[top]), [], CELLS
            level = key % SETTLED
            for u in [top] if key >= SETTLED else sorted((u for u in queue if key in queue[u]), reverse=True):  # a batch at least, with the next bounds
                rows.append(pulled(key, u, room))
                room -= len(rows[-1][0])
                if not room:
                    break
            *some, bound = (np.concatenate(v) for v in zip(*rows, strict=True))
            stale = np.flatnonzero(some[2] < len(found))
            if len(stale) and level < SMALLEST:
                bound[stale] = np.minimum(bound[stale], free.count(some[3][stale], some[4][stale], some[5][stale]))
                some[2][stale] = len(found)
                fell = bound < rows[-1][-1][0]
                put(level, bound[fell], tuple(v[fell] for v in some))
                some, bound = [v[~fell] for v in some], bound[~fell]
            i, j, _, row, col, up, low = some
            y, x = s2.centers_at(np.full(len(i), self.face), i, j, level)
            own, node = unsure(row, col, up, low)
            if level == SMALLEST:
                which, y, x = self._places(y, x, HALF_CELL / 2**level)
                n = counts(y, x)
            else:
                which = np.arange(len(i))
                n = free.count(row, col, reached(self, y, x, own, node, row, col, low))
            most = np.zeros(len(i), np.int64)
            np.maximum.at(most, which, n)
            hold = np.flatnonzero(n >= top)
            parts = [np.concatenate(v) for v in zip(*full.discs(y[hold], x[hold]), strict=True)] if len(hold) else ()
            for k in np.lexsort((parts[0], -parts[4])).tolist() if parts else ():
                at, a, b, one = (v[k : k + 1] for v in parts[:4])
                if (not max_clusters or len(found) < max_clusters) and free.count(a, b, one)[0] >= top:
                    free.take(int(a[0]), int(b[0]), one[0])
                    found.append((y[hold[at[0]]], x[hold[at[0]]]))
            # those that are settled wait for their turn
            done = (most >= bound) if level < SMALLEST else np.ones(len(i), bool)
            put(level + SETTLED, np.minimum(most, bound)[done], (i[done], j[done], np.full(done.sum(), len(found) if not len(hold) else -1), *(v[done] for v in some[3:])))
            if not done.all():
                # of the four cells below, only the free cells that are unsure are looked at
                where = np.cumsum(~done) - 1
                own, node = where[own[~done[own]]], node[~done[own]]
                i, j, row, col, low, bound = (v[~done] for v in (i, j, row, col, low, bound))
                half = 1 << (s2.MAX_LEVEL - level - 1)
                for p, q in ((0, 0), (0, half), (half, 0), (half, half)):
                    y, x = s2.centers_at(np.full(len(i), self.face), i + p, j + q, level + 1)
                    up = reached(view(level + 1, 1), y, x, own, node, row, col, low)
                    sure = reached(view(level + 1, -1), y, x, own, node, row, col, low)
                    put(level + 1, np.minimum(free.count(row, col, up), bound), (i + p, j + q, np.full(len(i), len(found)), row, col, up, sure))
        kept = [c for c, own in zip(found, free.own(), strict=True) if own >= min_points]
        return tuple(np.array(kept).reshape(-1, 2).T)

    def _places(self, y: np.ndarray, x: np.ndarray, away: float) -> tuple[np.ndarray, ...]:
        """(centre, lat, lon): some centres, and all places at one radius from two points that are not further than `away` from one."""
        out = [(np.arange(len(y)), y, x)]
        rim, near = ((2 * math.sin(m / geo.MEAN_RADIUS / 2)) ** 2 for m in (self.metres * (1 - 1e-7), away * 1.001 + 1e-4))
        for a in range(0, len(y), 64):
            ptr, at = disc_members(y[a : a + 64], x[a : a + 64], self.lat, self.lon, self.metres + away + 1e-3)
            own = np.repeat(np.arange(a, a + len(ptr) - 1), np.diff(ptr))
            c = _unit_vectors(y, x)
            ring = _square(c[own], self.p[at]) >= (2 * math.sin((self.metres - away - 1e-3) / geo.MEAN_RADIUS / 2)) ** 2
            own, at = own[ring], at[ring]
            first = np.searchsorted(own, np.arange(a, a + len(ptr)))
            rest = first[own - a + 1] - np.arange(len(own)) - 1
            for one, two in _ranges(np.arange(len(own)) + 1, rest):
                (*both,), ok = _rim_places(self.p[at[one]], self.p[at[two]], rim)
                for lat, lon in both:
                    inside = _square(c[own[one[ok]]], _unit_vectors(lat, lon)) <= near
                    out.append((own[one[ok]][inside], lat[inside], lon[inside]))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))


class _Free:
    """The cells of a raster that no taken disc covers."""

    def __init__(self, raster: Raster):
        self.side, self.shape, self.kind = raster.side, raster.shape, raster.kind
        self.steps, self.bits = np.arange(self.side), np.arange(self.side).astype(self.kind)
        self.cells = np.zeros((self.shape[0], self.shape[1] + self.side), bool)
        self.cells[raster.i, raster.j] = True
        self.packed = np.zeros(self.shape, self.kind)  # of each place the free cells from it on to the east
        for b in range(self.side):
            self.packed |= self.cells[:, b : b + self.shape[1]].astype(self.kind) << self.kind(b)
        self.taken: list[tuple[int, int, np.ndarray]] = []

    def count(self, row: np.ndarray, col: np.ndarray, maps: np.ndarray) -> np.ndarray:
        now = maps & self.packed[row[:, None] + self.steps, col[:, None]]
        return np.bitwise_count(now).sum(axis=1, dtype=np.int64)

    def take(self, a: int, b: int, one: np.ndarray) -> None:
        spread = (one[:, None] >> self.bits & self.kind(1)).astype(bool)
        self.taken.append((a, b, spread))
        self.cells[a : a + self.side, b : b + self.side] &= ~spread
        west, east = max(0, b - self.side + 1), min(self.shape[1], b + self.side)
        fresh = np.zeros((self.side, east - west), self.kind)
        for k in range(self.side):
            fresh |= self.cells[a : a + self.side, west + k : east + k].astype(self.kind) << self.kind(k)
        self.packed[a : a + self.side, west:east] = fresh

    def own(self) -> list[int]:
        """Of each taken disc the cells that no other covers."""
        covers = np.zeros(self.cells.shape, np.int32)
        for a, b, spread in self.taken:
            covers[a : a + self.side, b : b + self.side] += spread
        return [int((spread & (covers[a : a + self.side, b : b + self.side] == 1)).sum()) for a, b, spread in self.taken]


def cover_group(lat: np.ndarray, lon: np.ndarray, metres: float, min_points: int, mode: str, max_clusters: int = 0, density: int | None = None, blocks: Iterator[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres that cover one group's points, out of the mode's candidates or of those given."""
    if not len(lat):
        return np.zeros(0), np.zeros(0)
    _, identity = np.unique(s2.cell_ids(lat, lon, IDENTITY_LEVEL), return_inverse=True)
    blocks, least = candidates(lat, lon, metres, mode, density) if blocks is None else blocks, max(1, min_points)
    if (raster := Raster.of(lat, lon, metres)) is not None:
        wider = Raster.of(lat, lon, metres, HALF_CELL / 2**IDENTITY_LEVEL) if mode == "best" and raster.crowded(PAIRS) else None
        cy, cx = wider.widest(least, min_points, max_clusters) if wider is not None else raster.greedy(blocks, least, min_points, max_clusters)
    else:
        y, x, ptr, members = _kept(blocks, lat, lon, metres, least)
        taken = greedy(ptr, members, identity, min_points, max_clusters)
        cy, cx = y[taken], x[taken]
    if min_points <= 1:  # of the points that are left, the first of each identity becomes its own disc
        free = np.ones(len(lat), bool)
        free[disc_members(cy, cx, lat, lon, metres)[1]] = False
        while free.any():
            left = np.flatnonzero(free)
            left = left[np.unique(identity[left], return_index=True)[1]]
            cy, cx = np.r_[cy, lat[left]], np.r_[cx, lon[left]]
            free[left] = False
            free[disc_members(lat[left], lon[left], lat, lon, metres)[1]] = False
    return cy, cx


#: What the covering operators return: the group's points and how many of them its discs cover come with every disc.
COVER = "fid long, split long, cid long, lat double, lon double, points long, covered long"


def _discs(key: tuple, p_lat: np.ndarray, p_lon: np.ndarray, lat: np.ndarray, lon: np.ndarray, metres: float) -> pd.DataFrame:
    covered = len(np.unique(disc_members(lat, lon, p_lat, p_lon, metres)[1])) if len(lat) else 0
    return pd.DataFrame({"fid": key[0], "split": key[1], "cid": np.arange(len(lat)), "lat": lat, "lon": lon, "points": len(p_lat), "covered": covered})


def _located(points: DataFrame, split: Column | None) -> DataFrame:
    return points.select("fid", (F.lit(0).cast("long") if split is None else split.cast("long")).alias("split"), "lat", "lon").where("lat is not null and lon is not null")


def _groups(points: DataFrame, split: Column | None):
    return dealt(_located(points, split), "fid", "split").groupBy("fid", "split")


def greedy_cover(points: DataFrame, metres: float, min_points: int = 1, mode: str = "balanced", split: Column | None = None, max_clusters: int = 0, density: int | None = None) -> DataFrame:
    """Discs (COVER) for points (fid, lat, lon): every group is covered on its own."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["lat", "lon"])
        y, x = g["lat"].to_numpy(float), g["lon"].to_numpy(float)
        return _discs(key, y, x, *cover_group(y, x, metres, min_points, mode, max_clusters, density), metres)

    return _groups(points, split).applyInPandas(run, COVER)


def wide_cover(points: DataFrame, metres: float, min_points: int, mode: str = "balanced", split: Column | None = None, max_clusters: int = 0, density: int | None = None) -> DataFrame:
    """The discs of greedy_cover for wide groups with more points than a task can hold (modes fast and balanced, two points a disc at least).

    Such a group has density x density candidates, whatever its points. Candidates are made by rows, one task each,
    and only the points that one of them reaches meet in the group's task: a number that its candidates bound.
    """
    if mode not in DENSITY or min_points < 2:
        raise ValueError("wide_cover is for modes with a grid of candidates and discs of two points or more")
    n, group = density or DENSITY[mode], ["fid", "split"]
    places = settled(_located(points, split).groupBy(*group, "lat", "lon").agg(F.count("*").alias("n")))  # it is read twice
    exact = F.sum(F.col("lat").cast("decimal(18,15)") * F.col("n").cast("decimal(18,0)"))  # the same in any order
    sizes = settled(places.groupBy(*group).agg(F.sum("n").alias("points"), F.min("lat").alias("low"), F.max("lat").alias("high"), F.min("lon").alias("west"), F.max("lon").alias("east"), (exact.cast("double") / F.sum("n")).alias("mean")))
    bounds = ["low", "high", "west", "east", "mean"]

    def made(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y, x = (np.concatenate(v) for v in zip((np.zeros(0),) * 2, *_bounded_blocks(tuple(g[bounds].iloc[0]), metres, n, begin=key[2], end=key[2] + 1), strict=True))
        return pd.DataFrame({"fid": key[0], "split": key[1], "lat": y, "lon": x})

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["lat", "lon"])
        y, x = (np.repeat(g[v].to_numpy(float), g["n"]) for v in ("lat", "lon"))
        blocks = _bounded_blocks(tuple(g[bounds].iloc[0]), metres, n)
        return _discs(key, y, x, *cover_group(y, x, metres, min_points, mode, max_clusters, density, blocks), metres).assign(points=g["points"].iloc[0])

    rows = sizes.select(*group, *bounds, F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(GRID_ROWS))).alias("first"))
    made_of = dealt(rows, *group, "first").groupBy(*group, "first").applyInPandas(made, "fid long, split long, lat double, lon double")
    near = radius_join(places, made_of, metres * (1 + 1e-6), ["lat", "lon", "n"], [], on=("fid", "split")).drop("metres").distinct()
    return dealt(near.join(sizes, group), *group).groupBy(*group).applyInPandas(run, COVER)


def _tile_turns(band: Column, side: float) -> Column:
    """An even number of tiles around the Earth in a band of latitude, none narrower than the band is high."""
    top = F.least(F.lit(89.0), (F.abs(band.cast("double")) + 1.0) * F.lit(side))
    return F.greatest(F.lit(2), F.floor(F.lit(180.0) * F.cos(F.radians(top)) / F.lit(side)) * 2).cast("long")


def _tile_slot(lon: Column, turns: Column) -> Column:
    return F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) / F.lit(360.0) * turns), turns)


def tiled_cover(points: DataFrame, metres: float, min_points: int = 1, mode: str = "fast", side: float = 0.05, density: int | None = None) -> DataFrame:
    """(fid, cid, lat, lon): a greedy cover of points (fid, id, lat, lon) for groups that no single task can hold.

    The map is cut into tiles of `side` degrees, far wider than a disc, coloured like a two by two board. Colour
    after colour, each tile is covered greedily on its own: its discs have their centres in it and count the
    points, in it or next to it, that no earlier colour's disc has covered. Tiles of one colour never reach the
    same point. At last discs with too few points of their own go, and with min_points 1 points left over get
    discs of their own. Not for tiles at a pole.
    """
    reach = math.degrees(metres / geo.MEAN_RADIUS) * 1.001
    if side < 4 * reach:
        raise ValueError("a tile must be at least two discs wide")
    own = points.select(F.col("fid").cast("long").alias("fid"), "id", "lat", "lon").where("lat is not null and lon is not null")
    wide = F.lit(reach) / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + F.lit(reach))))
    near = own.select("*", F.explode(F.array_distinct(F.array(*(F.floor((F.col("lat") + k * reach) / F.lit(side)) for k in (0, -1, 1))))).alias("ty"), wide.alias("wide"))
    turns = _tile_turns(F.col("ty"), side)
    near = near.select("fid", "id", "lat", "lon", "ty", F.explode(F.array_distinct(F.array(*(_tile_slot(F.col("lon") + k * F.col("wide"), turns) for k in (0, -1, 1))))).alias("tx"), turns.alias("turns"))
    near = near.withColumn("colour", F.pmod("ty", F.lit(2)) * 2 + F.pmod("tx", F.lit(2)))
    kind = dict(points.dtypes)["id"]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["lat", "lon", "id"])
        ty, tx, turns = key[1], key[2], int(g["turns"].iloc[0])
        lat, lon = g["lat"].to_numpy(float), g["lon"].to_numpy(float)
        at = lambda y, x: (np.floor(y / side) == ty) & (np.floor(x % 360.0 / 360.0 * turns) % turns == tx)
        _, identity = np.unique(s2.cell_ids(lat, lon, IDENTITY_LEVEL), return_inverse=True)
        blocks = ((y[k], x[k]) for y, x in candidates(lat, lon, metres, mode, density) for k in (at(y, x),))
        y, x, ptr, members = _kept(blocks, lat, lon, metres, max(1, min_points))
        taken = greedy(ptr, members, identity, min_points, prune=False)
        hit = np.unique(np.concatenate([members[ptr[c] : ptr[c + 1]] for c in taken])) if taken else np.zeros(0, int)
        discs = pd.DataFrame({"fid": key[0], "id": None, "lat": y[taken], "lon": x[taken]})
        return pd.concat([discs, pd.DataFrame({"fid": key[0], "id": g["id"].to_numpy()[hit], "lat": np.nan, "lon": np.nan})])

    found = None
    for colour in range(4):
        left = near.where(F.col("colour") == colour)
        if found is not None:
            left = left.join(found.where("id is not null").select("fid", "id"), ["fid", "id"], "left_anti")
        one = settled(dealt(left, "fid", "ty", "tx").groupBy("fid", "ty", "tx").applyInPandas(run, f"fid long, id {kind}, lat double, lon double"))
        found = one if found is None else found.unionByName(one)
    discs = found.where("id is null").select("fid", F.xxhash64("lat", "lon").alias("cid"), "lat", "lon")
    cells = own.select("fid", s2.cell(F.col("lat"), F.col("lon"), IDENTITY_LEVEL).alias("cell"), "lat", "lon")
    pairs = radius_join(cells, discs, metres, ["cell"], ["cid"], on=("fid",)).select("fid", "cell", "cid").distinct()
    alone = pairs.groupBy("fid", "cell").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where("n = 1").groupBy("fid", "cid").count().where(F.col("count") >= min_points)
    kept = discs.join(alone.select("fid", "cid"), ["fid", "cid"], "left_semi")
    if min_points > 1:
        return kept
    cells = own.select("fid", "id", (s2.cell(F.col("lat"), F.col("lon"), IDENTITY_LEVEL) if metres >= 15.0 else F.xxhash64("lat", "lon")).alias("cell"), "lat", "lon")  # what one disc of a point in it covers
    rest = cells.join(radius_join(cells, kept, metres, ["id"], ["cid"], on=("fid",)).select("fid", "id"), ["fid", "id"], "left_anti")
    rest = rest.groupBy("fid", "cell").agg(F.min(F.struct("lat", "lon")).alias("p")).select("fid", F.col("cell").alias("cid"), "p.lat", "p.lon")
    return kept.unionByName(rest)


# --- unit-disc cover on the tangent plane ---------------------------------------------------------


class Plane:
    """Tangent plane of the ellipsoid at a group's middle, as [east, north] in units of the disc radius."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, metres: float, total: np.ndarray | None = None):
        lat0, lon0 = self._radial(self._ecef(lat, lon).sum(axis=0) if total is None else total)
        self.up = np.array([math.cos(lat0) * math.cos(lon0), math.cos(lat0) * math.sin(lon0), math.sin(lat0)])
        self.east = np.array([-math.sin(lon0), math.cos(lon0), 0.0])
        self.north = np.cross(self.up, self.east)
        centre = self._ecef(math.degrees(lat0), math.degrees(lon0))
        self.height, self.offset = float(centre @ self.up), float(centre @ self.north)
        self.unit = 0.5 * geo.POLAR_RADIUS * math.sin(2 * metres / geo.POLAR_RADIUS)

    @staticmethod
    def _ecef(lat, lon) -> np.ndarray:
        p, q, flat = np.radians(lat), np.radians(lon), (geo.POLAR_RADIUS / geo.EQUATOR_RADIUS) ** 2
        n = geo.EQUATOR_RADIUS / np.sqrt(np.cos(p) ** 2 + flat * np.sin(p) ** 2)
        return np.stack([n * np.cos(p) * np.cos(q), n * np.cos(p) * np.sin(q), n * flat * np.sin(p)], axis=-1)

    @staticmethod
    def _radial(v: np.ndarray):
        flat = (geo.POLAR_RADIUS / geo.EQUATOR_RADIUS) ** 2
        return np.arctan2(v[..., 2], flat * np.hypot(v[..., 0], v[..., 1])), np.arctan2(v[..., 1], v[..., 0])

    def forward(self, lat, lon) -> np.ndarray:
        v = self._ecef(np.asarray(lat, float), np.asarray(lon, float))
        v = v * (self.height / (v @ self.up))[..., None]
        return np.stack([v @ self.east, v @ self.north - self.offset], axis=-1) / self.unit

    def reverse(self, xy) -> tuple[np.ndarray, np.ndarray]:
        xy = np.asarray(xy, float) * self.unit
        v = self.up * self.height + xy[..., :1] * self.east + (xy[..., 1:] + self.offset) * self.north
        lat, lon = self._radial(v)
        return np.degrees(lat), np.degrees(lon)


def unit_disc_cover(lat: np.ndarray, lon: np.ndarray, metres: float, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """Square buckets of side sqrt 2; neighbours whose joint bounds fit one disc merge; the rest stand alone."""
    if not len(lat):
        return np.zeros(0), np.zeros(0)
    plane = Plane(lat, lon, metres)
    xy = plane.forward(lat, lon)
    cells, at, count = np.unique(np.floor(xy / math.sqrt(2)).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    at = at.ravel()
    low, high = np.full((len(cells), 2), np.inf), np.full((len(cells), 2), -np.inf)
    np.minimum.at(low, at, xy)
    np.maximum.at(high, at, xy)
    xy, *_ = _merged(cells, low, high, count, *_fitting(cells, low, high, count, min_points), min_points)
    return plane.reverse(xy) if len(xy) else (np.zeros(0), np.zeros(0))


def _fitting(cells: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of some cells in order its neighbours S N E W SW SE NE NW, and which are there, with joint bounds that fit and points that suffice."""
    key = cells[:, 0] * (1 << 32) + cells[:, 1]
    step = np.array([(0, -1), (0, 1), (1, 0), (-1, 0), (-1, -1), (1, -1), (1, 1), (-1, 1)])
    other = key[:, None] + step[:, 0] * (1 << 32) + step[:, 1]
    at = np.minimum(np.searchsorted(key, other), len(key) - 1)
    extent = np.maximum(high[:, None], high[at]) - np.minimum(low[:, None], low[at])
    return at, (key[at] == other) & ((extent**2).sum(axis=2) <= 4) & (count[:, None] + count[at] > min_points)


def _merged(cells: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, at: np.ndarray, fits: np.ndarray, min_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of the merged cells, then of those alone; the cell of each, and whether it is alone."""
    flagged = np.ones(len(cells), bool)
    pairs = []
    for k in np.flatnonzero(fits.any(axis=1)).tolist():
        for o in at[k, fits[k]].tolist():
            if flagged[o]:
                pairs.append((k, o))
                flagged[k] = flagged[o] = False
                break
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    k = np.flatnonzero(flagged & (count >= min_points))
    alone = np.where(count[k, None] == 1, low[k], (cells[k] + 0.5) * math.sqrt(2))
    return np.concatenate([(np.minimum(low[a], low[b]) + np.maximum(high[a], high[b])) / 2, alone]), np.r_[a, k], np.repeat([0, 1], [len(a), len(k)])


#: Cells along a tile's side in which wide_fastest_cover merges, round after round; the last round takes what is left.
MERGE_TILES = (256, 4096, 1 << 40)


def wide_fastest_cover(points: DataFrame, metres: float, min_points: int = 1, split: Column | None = None) -> DataFrame:
    """The discs of fastest_cover for groups that no task can hold.

    Cells are counted as rows. Which cells merge depends only on cells that they are joined to by neighbours that fit:
    those whose like lie within a tile of cells are settled there, all others in a larger tile of the next round.
    """
    from terracover.operators.routing import geohashes

    group, bucket = ["fid", "split"], ["n", "x0", "y0", "x1", "y1"]
    places = settled(_located(points, split).groupBy(*group, "lat", "lon").agg(F.count("*").alias("n")))  # it is read three times
    flat = (geo.POLAR_RADIUS / geo.EQUATOR_RADIUS) ** 2
    p, q = F.radians("lat"), F.radians("lon")
    up = F.lit(geo.EQUATOR_RADIUS) / F.sqrt(F.cos(p) * F.cos(p) + F.lit(flat) * F.sin(p) * F.sin(p))
    exact = lambda v: F.sum(v.cast("decimal(18,9)") * F.col("n").cast("decimal(18,0)")).cast("double")  # noqa: E731  the same in any order
    sums = [exact(up * F.cos(p) * F.cos(q)).alias("sx"), exact(up * F.cos(p) * F.sin(q)).alias("sy"), exact(up * F.lit(flat) * F.sin(p)).alias("sz")]
    sizes = settled(places.groupBy(*group).agg(F.sum("n").alias("points"), *sums))
    plane = lambda g: Plane(None, None, metres, g[["sx", "sy", "sz"]].iloc[0].to_numpy(float))

    def laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, g in batch.groupby(group):
                xy = plane(g).forward(g["lat"].to_numpy(), g["lon"].to_numpy())
                cell = np.floor(xy / math.sqrt(2)).astype(np.int64)
                yield pd.DataFrame({"fid": g["fid"], "split": g["split"], "bx": cell[:, 0], "by": cell[:, 1], "x": xy[:, 0], "y": xy[:, 1], "n": g["n"]})

    cells = places.join(sizes, group).mapInPandas(laid, "fid long, split long, bx long, by long, x double, y double, n long")
    cells = cells.groupBy(*group, "bx", "by").agg(F.sum("n").alias("n"), *(f(v).alias(v + k) for k, f in (("0", F.min), ("1", F.max)) for v in "xy"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, side = g.sort_values(["bx", "by"]), int(g["side"].iloc[0])
        cell, low, high, count = (g[c].to_numpy() for c in (["bx", "by"], ["x0", "y0"], ["x1", "y1"], "n"))
        at, fits = _fitting(cell, low, high, count, min_points)
        more = ((cell % side == 0) | (cell % side == side - 1)).any(axis=1) & (side < MERGE_TILES[-1])
        while (new := (fits & more[at]).any(axis=1) & ~more).any():
            more |= new
        rows = np.cumsum(~more) - 1
        own, kept = rows[at[~more]], np.flatnonzero(~more)
        xy, of, alone = _merged(cell[kept], low[kept], high[kept], count[kept], own, fits[kept], min_points)
        lat, lon = plane(g).reverse(xy) if len(xy) else (np.zeros(0), np.zeros(0))
        made = g.iloc[kept[of]].assign(kind=alone, lat=lat, lon=lon, code=geohashes(lat, lon, 9))
        return pd.concat([made, g[more].assign(kind=2, lat=np.nan, lon=np.nan, code=0)])[[*group, "bx", "by", *bucket, "kind", "lat", "lon", "code"]]

    out = None
    for side in MERGE_TILES:
        tiles = cells.join(sizes, group).withColumns({"side": F.lit(side), "tx": F.floor(F.col("bx") / side), "ty": F.floor(F.col("by") / side)} if side < MERGE_TILES[-1] else {"side": F.lit(side), "tx": F.lit(0), "ty": F.lit(0)})
        schema = "fid long, split long, bx long, by long, n long, x0 double, y0 double, x1 double, y1 double, kind int, lat double, lon double, code long"
        done = settled(dealt(tiles, *group, "tx", "ty").groupBy(*group, "tx", "ty").applyInPandas(run, schema))
        cells = done.where("kind = 2").select(*group, "bx", "by", *bucket)
        discs = done.where("kind < 2")
        out = discs if out is None else out.unionByName(discs)
    place = lambda c: F.lpad((F.col(c) + (1 << 40)).cast("string"), 15, "0")
    order = F.concat(F.lpad(F.hex("fid"), 16, "0"), F.lpad(F.hex("split"), 16, "0"), place("code"), F.col("kind").cast("string"), place("bx"), place("by"))
    found = settled(numbered(out.select(*group, "lat", "lon", order.alias("order")), "order", "at").drop("order"))
    covered = radius_join(places, found, metres, ["lat", "lon", "n"], [], on=("fid", "split")).drop("metres").distinct().groupBy(*group).agg(F.sum("n").alias("covered"))
    sizes = sizes.select(*group, "points").join(found.groupBy(*group).agg(F.min("at").alias("first")), group).join(covered, group, "left")
    return found.join(sizes, group).select(*group, (F.col("at") - F.col("first")).alias("cid"), "lat", "lon", "points", F.coalesce("covered", F.lit(0)).alias("covered"))


def fastest_cover(points: DataFrame, metres: float, min_points: int = 1, split: Column | None = None) -> DataFrame:
    """Discs (COVER): the unit-disc cover of each group, in geohash order."""
    from terracover.operators.routing import geohashes

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["lat", "lon"])
        p_lat, p_lon = g["lat"].to_numpy(float), g["lon"].to_numpy(float)
        y, x = unit_disc_cover(p_lat, p_lon, metres, min_points)
        order = np.argsort(geohashes(y, x, 9), kind="stable")
        return _discs(key, p_lat, p_lon, y[order], x[order], metres)

    return _groups(points, split).applyInPandas(run, COVER)


def bucket_cover(points: DataFrame, side: float, min_points: int) -> DataFrame:
    """(bx, by, n): the first phase alone, a plain grid count in degrees."""
    return points.groupBy(F.floor(F.col("lon") / F.lit(side)).alias("bx"), F.floor(F.col("lat") / F.lit(side)).alias("by")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points)


# --- centring -------------------------------------------------------------------------------------


def first_claims(pairs: DataFrame, counts: DataFrame, cluster: str = "cid", point: str = "id") -> DataFrame:
    """(point, cluster): every point goes to the disc with the most points that covers it, then the least id."""
    both = pairs.join(counts.select(cluster, "n_all"), cluster)
    return both.groupBy(point).agg(F.min(F.struct((-F.col("n_all")).alias("n"), F.col(cluster).alias("c"))).alias("m")).select(point, F.col("m.c").alias(cluster))


def nearby_claims(points: DataFrame, clusters: DataFrame, metres: float) -> DataFrame:
    """(id, cid): first_claims of points (id, lat, lon) on discs (cid, lat, lon); pairs are never shuffled, but met three times."""
    n_all = radius_join(points, clusters, metres, ["id"], ["cid"]).groupBy("cid").agg(F.count("*").alias("n_all"))
    sized = settled(clusters.select("cid", "lat", "lon").join(n_all, "cid"))
    top = radius_join(points, sized, metres, ["id"], ["n_all"]).groupBy("id").agg(F.max("n_all").alias("top"))
    wanted = points.select("id", "lat", "lon").join(top, "id")
    return radius_join(wanted, sized, metres, ["id", "top"], ["cid", "n_all"]).where("n_all = top").groupBy("id").agg(F.min("cid").alias("cid"))


def enclosing(lat: np.ndarray, lon: np.ndarray, metres: float, shuffles: int = 100, seed: int = 42) -> tuple[float, float] | None:
    """A disc within the radius around all points, by randomised incremental construction; None if none is found.

    Two points meet in their planar midpoint, three in their triangle's centroid.
    """
    rng, n = np.random.default_rng(seed), len(lat)
    if not n:
        return None

    def far(y: float, x: float, upto: int, order) -> int:
        d = metres_between(lat[order[:upto]], lon[order[:upto]], y, x)
        k = np.flatnonzero(d > metres)
        return int(k[0]) if len(k) else -1

    for _ in range(shuffles):
        order = rng.permutation(n)
        y, x = lat[order[0]], lon[order[0]]
        i = far(y, x, n, order)
        if i < 0:
            return float(y), float(x)
        y, x = (lat[order[i]] + lat[order[0]]) / 2, (lon[order[i]] + lon[order[0]]) / 2
        j = far(y, x, n, order)
        if j < 0:
            return float(y), float(x)
        three = order[[0, i, j]]
        y, x = lat[three].mean(), lon[three].mean()
        if far(y, x, n, order) < 0:
            return float(y), float(x)
    y, x = float((lat.min() + lat.max()) / 2), float((lon.min() + lon.max()) / 2)
    return (y, x) if far(y, x, n, np.arange(n)) < 0 else None


def centred(clusters: DataFrame, members: DataFrame, metres: float) -> DataFrame:
    """(cid, lat, lon): each disc moved onto its members (cid, p_lat, p_lon) where all stay covered."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = g[g["p_lat"].notna()].sort_values(["p_lat", "p_lon"])
        got = enclosing(own["p_lat"].to_numpy(float), own["p_lon"].to_numpy(float), metres)
        y, x = got or (g["lat"].iloc[0], g["lon"].iloc[0])
        return pd.DataFrame({"cid": g["cid"].iloc[:1], "lat": [y], "lon": [x]})

    return dealt(clusters.select("cid", "lat", "lon").join(members, "cid", "left"), "cid").groupBy("cid").applyInPandas(run, "cid long, lat double, lon double")


# --- S2 blocks ------------------------------------------------------------------------------------


def s2_counts(points: DataFrame, level: int) -> DataFrame:
    """(cell, n): points per cell."""
    return points.select(s2.cell(F.col("lat"), F.col("lon"), level).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def s2_block_cover(points: DataFrame, blocks: DataFrame, level: int, size: int, min_points: int) -> DataFrame:
    """Blocks (cell, ...) whose size x size neighbourhood holds at least max(min_points, 1) points, with n."""

    def around(c: pd.Series) -> pd.Series:
        return pd.Series([ids.tolist() for ids in s2.neighbourhoods(c.to_numpy(np.int64), size)], dtype=object)

    around.__annotations__ = {"c": pd.Series, "return": pd.Series}
    near = blocks.select("cell").distinct().select(F.col("cell").alias("block"), F.explode(F.pandas_udf(around, "array<long>")("cell")).alias("cell"))
    found = near.join(s2_counts(points, level), "cell").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, min_points))
    return found.select(F.col("block").alias("cell"), "n")
