"""Orders and tours over cluster centres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracover.functions import geo, geohash, s2
from terracover.operators.cover import _unit_vectors, metres_between
from terracover.operators.grouping import dealt


def _ordered(stops: DataFrame, *order: Column) -> DataFrame:
    """seq from 0 in the given order; ties go by the earlier seq."""
    return stops.withColumn("seq", F.row_number().over(Window.partitionBy("fid").orderBy(*order, "seq")) - 1)


def by_unset(stops: DataFrame) -> DataFrame:
    return stops


def by_lat_lon(stops: DataFrame) -> DataFrame:
    return _ordered(stops, F.desc("lat"), F.desc("lon"))


def by_geohash(stops: DataFrame) -> DataFrame:
    return _ordered(stops, F.coalesce(geohash.encode(F.col("lat"), F.col("lon"), 12), F.lit("")))


def by_point_count(stops: DataFrame) -> DataFrame:
    """Most covered points first; needs n_all."""
    return _ordered(stops, F.desc("n_all"))


def by_s2(stops: DataFrame) -> DataFrame:
    return _ordered(stops.withColumn("__cell", s2.cell(F.col("lat"), F.col("lon"), 30)), s2.order_key(F.col("__cell"))).drop("__cell")


def by_random(stops: DataFrame, seed: int = 42) -> DataFrame:
    return _ordered(stops, F.xxhash64(F.lit(seed), "lat", "lon"))


def geohashes(lat: np.ndarray, lon: np.ndarray, length: int) -> np.ndarray:
    """Integers that sort like the geohashes of a length."""
    n = 5 * length
    nx, ny = (n + 1) // 2, n // 2
    x = np.minimum(np.floor((lon + 180) / 360 * 2.0**nx), 2.0**nx - 1).astype(np.int64)
    y = np.minimum(np.floor((lat + 90) / 180 * 2.0**ny), 2.0**ny - 1).astype(np.int64)
    out = np.zeros(len(lat), np.int64)
    for at in range(n):
        axis, bits = (x, nx) if at % 2 == 0 else (y, ny)
        out = out << 1 | (axis >> (bits - 1 - at // 2)) & 1
    return out


#: Parts that the rows of a tour's matrix are dealt to.
MATRIX_PARTS = 16


def distances(stops: DataFrame) -> DataFrame:
    """(fid, a, b, metres): whole metres from each stop (fid, seq, lat, lon) of a tour to each, itself included.

    A tour's stops are dealt to MATRIX_PARTS parts, and all of them come to each part: what is shuffled grows with the
    stops, only the result with their square.
    """
    a = stops.select("fid", F.pmod(F.xxhash64("seq"), F.lit(MATRIX_PARTS)).alias("part"), F.col("seq").alias("a"), "lat", "lon")
    b = stops.select("fid", F.explode(F.array(*(F.lit(k).cast("long") for k in range(MATRIX_PARTS)))).alias("part"), F.col("seq").alias("b"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    metres = F.shiftright(F.floor(geo.haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"), geo.MATRIX_RADIUS) * 2) + 1, 1)  # halves go up, as in round, which costs more
    return dealt(a, "fid", "part").join(dealt(b, "fid", "part"), ["fid", "part"]).select("fid", "a", "b", metres.alias("metres"))


def distance_matrix(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Rounded metres between all stops of a group."""
    return np.round(metres_between(lat[:, None], lon[:, None], lat[None], lon[None]) * (geo.MATRIX_RADIUS / geo.MEAN_RADIUS))


def nearest(y: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place on a plane its k nearest others, nearest first, then by index, and their squared distances.

    Places lie in leaves of 16, leaves in strips. A leaf looks into the leaves nearest to its box, twice as many
    each time, until none that is left can hold a nearer place; a bounded number of pairs is held at a time.
    """
    n, size = len(y), 16
    leaves = -(-n // size)
    strip = np.empty(n, np.int64)
    strip[np.lexsort((y, x))] = np.arange(n) // (size * math.ceil(math.sqrt(leaves)))
    order = np.r_[np.lexsort((x, y, strip)), np.full(leaves * size - n, -1)].reshape(leaves, size)
    py, px = np.where(order < 0, np.inf, y[order]), np.where(order < 0, np.inf, x[order])
    box = [f(np.where(order < 0, v[order[:, :1]], v[order]), axis=1) for v in (y, x) for f in (np.min, np.max)]
    out, far = np.empty((n, k), np.int32), np.empty((n, k))
    todo, width = np.arange(leaves), min(leaves, 16)
    while len(todo):
        rows, again = max(1, min((1 << 20) // leaves, (1 << 20) // (width * size * size))), []
        for a in range(0, len(todo), rows):
            own = todo[a : a + rows]
            away = sum(np.maximum(0.0, np.maximum(lo - hi[own, None], lo[own, None] - hi)) ** 2 for lo, hi in (box[:2], box[2:]))
            near = np.argpartition(away, width - 1, axis=1)[:, :width] if width < leaves else np.broadcast_to(np.arange(leaves), away.shape)
            np.put_along_axis(away, near, np.inf, axis=1)
            who = np.sort(order[near].reshape(len(own), -1), axis=1)
            d = (py[own][:, :, None] - y[who][:, None]) ** 2 + (px[own][:, :, None] - x[who][:, None]) ** 2
            d[np.broadcast_to(who[:, None] < 0, d.shape) | (who[:, None] == order[own][:, :, None])] = np.inf
            if d.shape[2] > k:
                some = np.argpartition(d, k - 1, axis=2)[:, :, :k]
                edge = np.take_along_axis(d, some, axis=2).max(axis=2)
            else:
                some, edge = np.broadcast_to(np.arange(d.shape[2]), d.shape), np.full(d.shape[:2], np.inf)
            real = order[own] >= 0
            done = (np.where(real, edge, 0.0).max(axis=1) <= away.min(axis=1)) | (width == leaves)
            again.append(own[~done])
            real &= done[:, None]
            some, d = some[real], d[real]
            rank = np.take_along_axis(d, some, axis=1)
            who = np.broadcast_to(who[:, None], (*real.shape, who.shape[1]))[real]
            who = np.take_along_axis(who, some, axis=1)
            by = np.lexsort((who, rank), axis=1)[:, :k]
            out[order[own][real]], far[order[own][real]] = np.take_along_axis(who, by, axis=1), np.take_along_axis(rank, by, axis=1)
        todo, width = np.concatenate(again), min(leaves, 2 * width)
    return out, far


def tour_order(lat: np.ndarray, lon: np.ndarray, neighbours: int = 10, rounds: int = 40) -> np.ndarray:
    """A short closed tour from stop 0: cheapest next arc, then 2-opt and Or-opt moves over near neighbours in turn."""
    n = len(lat)
    if n < 4:
        return np.arange(n)
    y, x = np.radians(lat), np.radians(lon) * np.cos(np.radians(lat.mean()))
    near, far = nearest(y, x, min(max(neighbours, 24), n - 1))
    sure = np.inf if near.shape[1] == n - 1 else far[:, -1:]  # what is nearer is listed
    known = far < sure
    del far
    order = np.empty(n, np.int64)
    left, rest = np.ones(n, bool), np.arange(n)
    at = 0
    for k in range(n):
        order[k] = at
        left[at] = False
        if k + 1 < n:
            free = left[near[at]] & known[at]
            first = int(free.argmax())
            if free[first]:
                at = int(near[at, first])
            else:
                if len(rest) > 2 * (n - k):
                    rest = rest[left[rest]]
                at = int(rest[np.argmin(np.where(left[rest], (y[rest] - y[at]) ** 2 + (x[rest] - x[at]) ** 2, np.inf))])
    dist = lambda a, b: np.hypot(y[a] - y[b], x[a] - x[b])
    near = near[:, : min(neighbours, n - 1)].astype(np.int64)
    for _ in range(rounds):
        turned, order = _reversals(order, near, dist)
        moved, order = _moves(order, near, dist)
        if not turned and not moved:
            break
    start = int(np.flatnonzero(order == 0)[0])
    return np.roll(order, -start)


#: Rows of neighbours, and moves found, that a tour looks at together.
ROWS, MOVES = 1 << 14, 1 << 12


def _reversals(order: np.ndarray, near: np.ndarray, dist) -> tuple[bool, np.ndarray]:
    """2-opt: the best reversals that do not overlap."""
    n, k = near.shape
    pos = np.empty(n, np.int64)
    pos[order] = np.arange(n)
    after = np.empty(n, np.int64)
    after[order] = np.roll(order, -1)
    found = []
    for s in range(0, n, ROWS):
        c = near[s : s + ROWS].ravel()
        a = np.repeat(np.arange(s, s + len(c) // k), k)
        gain = dist(a, after[a]) + dist(c, after[c]) - dist(a, c) - dist(after[a], after[c])
        good = np.flatnonzero(gain > 1e-12)
        found.append((gain[good], pos[a[good]], pos[c[good]]))
    gain, p, q = (np.concatenate(v) for v in zip(*found, strict=True))
    best = np.argsort(-gain, kind="stable")
    done, any_ = np.zeros(n + 1, bool), False
    order = order.copy()
    for s in range(0, len(best), MOVES):
        some = best[s : s + MOVES]
        i, j = np.minimum(p[some], q[some]), np.maximum(p[some], q[some])
        before = np.r_[0, np.cumsum(done)]
        open_ = (i < j) & (before[np.minimum(j + 2, n + 1)] == before[i])
        for i, j in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            if done[i : j + 2].any():
                continue
            order[i + 1 : j + 1] = order[i + 1 : j + 1][::-1]
            done[i : j + 2] = True
            any_ = True
    return any_, order


def _moves(order: np.ndarray, near: np.ndarray, dist) -> tuple[bool, np.ndarray]:
    """Or-opt: one to three stops in a row go, either way round, between two others; the best moves that share no stop."""
    n, k = near.shape
    if n < 8:
        return False, order
    pos = np.empty(n, np.int64)
    pos[order] = np.arange(n)
    at = lambda i: order[i % n]
    leg = dist(order, np.roll(order, -1))  # to the next stop
    found = []
    for size in (1, 2, 3):
        for end in (0, size - 1) if size > 1 else (0,):  # the stop that comes next to its near neighbour
            ways = [[], [], [], []]
            for s in range(0, n, ROWS):
                i = np.repeat(np.arange(s, min(n, s + ROWS)), k)
                first, last = at(i), at(i + size - 1)
                c = near[at(i[::k] + end)].ravel()
                free = (pos[c] - i) % n >= size
                left = leg[i - 1] + leg[(i + size - 1) % n] - np.repeat(dist(at(i[::k] - 1), at(i[::k] + size)), k)
                to = lambda other: (d := dist(other, first), d if size == 1 else dist(other, last))  # noqa: B023, E731
                own = to(c)
                for way in (0, 1):  # between c and the stop after it, or before it
                    other = at(pos[c] + 1 - 2 * way)
                    ok = free & ((pos[other] - i) % n >= size)
                    there, gap = to(other), leg[pos[c] - way]
                    for flip in (0, 1):
                        here = own[flip] + there[1 - flip] if way == 0 else there[flip] + own[1 - flip]
                        gain = left - (here - gap)
                        g = np.flatnonzero(ok & (gain > 1e-12))
                        lead = (pos[c[g]] - way) % n
                        ways[2 * way + flip].append((gain[g], i[g].astype(np.int32), np.full(len(g), size, np.int8), lead.astype(np.int32), np.full(len(g), flip, np.int8)))
            found += [part for way in ways for part in way]
    gain, *move = (np.concatenate(v) for v in zip(*found, strict=True))
    del found
    if not len(gain):
        return False, order
    best = np.argsort(-gain, kind="stable")
    used = np.zeros(n, bool)
    gone, put = np.zeros(n, bool), {}
    for s in range(0, len(best), MOVES):
        i, size, lead, flip = (v[best[s : s + MOVES]].astype(np.int64) for v in move)
        busy = used[lead] | used[(lead + 1) % n]
        for step in range(-1, 4):
            busy |= used[(i + step) % n] & (step <= size)
        for i, size, lead, flip in zip(*(v[~busy].tolist() for v in (i, size, lead, flip)), strict=True):
            own = np.arange(i - 1, i + size + 1) % n
            ends = [lead, (lead + 1) % n]
            if used[own].any() or used[ends].any():
                continue
            used[own] = used[ends] = True
            seg = own[1:-1]
            gone[seg] = True
            put[lead] = seg[::-1] if flip else seg
    out = []
    for p in range(n):
        if not gone[p]:
            out.append(p)
        if p in put:
            out += put[p].tolist()
    return bool(put), order[np.array(out)]


def by_tour(stops: DataFrame, split: Column | None = None) -> DataFrame:
    """A tour per fence, all columns of stops kept; or per split cell with the pieces joined (fid, seq, lat, lon)."""
    if split is None:

        def whole(g: pd.DataFrame) -> pd.DataFrame:
            g = g.iloc[_solved(g)]
            return g.assign(seq=np.arange(len(g)))

        rows = stops.withColumn("seq", F.col("seq").cast("long"))
        return dealt(rows, "fid").groupBy("fid").applyInPandas(whole, rows.schema)

    def part(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.iloc[_solved(g)]
        return pd.DataFrame({"fid": key[0], "cell": key[1], "seq": np.arange(len(g)), "lat": g["lat"].to_numpy(), "lon": g["lon"].to_numpy()})

    keyed = stops.select("fid", split.cast("long").alias("cell"), "lat", "lon")
    return joined(dealt(keyed, "fid", "cell").groupBy("fid", "cell").applyInPandas(part, "fid long, cell long, seq long, lat double, lon double"))


def _solved(g: pd.DataFrame) -> np.ndarray:
    """Positions of a group's stops in tour order, started from the first in geohash order."""
    lat, lon = g["lat"].to_numpy(float), g["lon"].to_numpy(float)
    first = np.argsort(geohashes(lat, lon, 12), kind="stable")
    return first[tour_order(lat[first], lon[first])]


def closest(p: np.ndarray, q: np.ndarray) -> int:
    """The first of stops p [lat, lon] with the least distance to any of q: runs of stops meet, the nearest boxes first."""
    sides = []
    for v in (p, q):
        first = np.arange(0, len(v), max(64, len(v) // 1024))
        u = _unit_vectors(v[:, 0], v[:, 1])
        sides.append((first, np.r_[first[1:], len(v)], np.minimum.reduceat(u, first), np.maximum.reduceat(u, first)))
    (a0, a1, low, high), (b0, b1, under, over) = sides
    away = np.sqrt(sum(np.maximum(0.0, np.maximum(under[:, k] - high[:, None, k], low[:, None, k] - over[:, k])) ** 2 for k in range(3)))
    best, at = math.inf, 0
    for k in np.argsort(away, axis=None, kind="stable"):
        i, j = divmod(int(k), len(b0))
        if away[i, j] > 2 * math.sin(min(best / geo.MEAN_RADIUS, math.pi) / 2) * (1 + 1e-6) + 1e-14:
            break
        own, other = p[a0[i] : a1[i]], q[b0[j] : b1[j]]
        d = metres_between(own[:, None, 0], own[:, None, 1], other[None, :, 0], other[None, :, 1]).min(axis=1)
        best, at = min((best, at), (float(d.min()), int(a0[i] + np.argmin(d))))
    return at


def joined(tours: DataFrame) -> DataFrame:
    """One tour per fence out of those of its cells (fid, cell, seq, lat, lon).

    The cells' centroids are toured first; each cell's tour is rotated so that its stop nearest to the
    next cell's tour comes first. Fewer than three cells follow each other as they are. A fence's stops
    meet in one task; fences are bounded by their number of discs.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        parts = [p.sort_values("seq")[["lat", "lon"]].to_numpy(float) for _, p in g.groupby("cell")]
        if len(parts) >= 3:
            mid = np.array([p.mean(axis=0) for p in parts])
            parts = [parts[i] for i in tour_order(mid[:, 0], mid[:, 1])]
            turned = []
            for p, q in zip(parts, [*parts[1:], parts[0]], strict=True):
                turned.append(np.roll(p, -closest(p, q), axis=0))
            parts = turned
        out = np.concatenate(parts)
        return pd.DataFrame({"fid": key[0], "seq": np.arange(len(out)), "lat": out[:, 0], "lon": out[:, 1]})

    return dealt(tours, "fid").groupBy("fid").applyInPandas(run, "fid long, seq long, lat double, lon double")


def rotated(stops: DataFrame, best: DataFrame) -> DataFrame:
    """The tour turned so that its last stop that is a best cluster (same geohash-12) comes first."""
    code = geohash.encode(F.col("lat"), F.col("lon"), 12)
    marks = best.select("fid", code.alias("__g")).distinct()
    full = stops.withColumn("__g", code).join(marks.withColumn("__hit", F.lit(True)), ["fid", "__g"], "left")
    part = Window.partitionBy("fid")
    k = F.coalesce(F.max(F.when(F.col("__hit"), F.col("seq"))).over(part), F.lit(0))
    return full.withColumn("seq", F.pmod(F.col("seq") - k, F.count("*").over(part))).drop("__g", "__hit")


SORTS = {"unset": by_unset, "latlon": by_lat_lon, "geohash": by_geohash, "pointcount": by_point_count, "s2": by_s2, "random": by_random, "tsp": by_tour}
