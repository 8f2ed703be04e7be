"""Tiling fences with discs, one task per fence, or with S2 blocks, one row per coarse cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracover.functions import s2
from terracover.operators.cover import lattice, metres_between
from terracover.operators.grouping import dealt

SCHEMA = "fid long, seq long, lat double, lon double"


def _parity(p: np.ndarray, e: np.ndarray) -> np.ndarray:
    x1, y1, x2, y2 = (e[:, k] for k in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((y1 > p[:, :1]) != (y2 > p[:, :1])) & (p[:, 1:] < (x2 - x1) * (p[:, :1] - y1) / (y2 - y1) + x1)
    return cross.sum(axis=1) % 2 == 1


def ring_distance(p: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Metres from [lat, lon] points to the nearest edge (x1, y1, x2, y2)."""
    d = e[:, 2:] - e[:, :2]
    square = np.maximum((d * d).sum(axis=1), 1e-300)
    t = np.clip(((p[:, 1:] - e[:, 0]) * d[:, 0] + (p[:, :1] - e[:, 1]) * d[:, 1]) / square, 0, 1)
    return metres_between(p[:, :1], p[:, 1:], e[:, 1] + t * d[:, 1], e[:, 0] + t * d[:, 0]).min(axis=1)


def by_radius(edges: DataFrame, metres: float) -> DataFrame:
    """Disc centres per fence, part by part: lattice points inside a part or within the radius of any of its rings.

    A part has a lattice of its own, over its own bounds, and is a task of its own.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        e = g.sort_values(["ring", "seq"])[["ex1", "ey1", "ex2", "ey2"]].to_numpy(float)
        p = lattice(e[:, [0, 2]].min(), e[:, [1, 3]].min(), e[:, [0, 2]].max(), e[:, [1, 3]].max(), metres)
        p = p[_parity(p, e) | (ring_distance(p, e) <= metres)]
        return pd.DataFrame({"fid": key[0], "seq": np.arange(len(p)), "lat": p[:, 0], "lon": p[:, 1], **({"part": key[1]} if len(key) > 1 else {})})

    if "part" not in edges.columns:
        return dealt(edges, "fid").groupBy("fid").applyInPandas(run, SCHEMA)
    found = dealt(edges, "fid", "part").groupBy("fid", "part").applyInPandas(run, f"{SCHEMA}, part int")
    order = Window.partitionBy("fid").orderBy("part", "seq")
    return found.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


#: Levels between a coarse cell, the unit that one row of by_s2's work covers, and the blocks' cells.
REFINED = 6


def _meeting(v: np.ndarray, e: np.ndarray, chunk: int = 1_000_000) -> np.ndarray:
    """Which cells (n, 4, 2) share area or boundary with the fence of these edges."""
    out = _parity(v.mean(axis=1), e) | _parity(v[:, 0], e)
    low, high, ends = v.min(axis=1), v.max(axis=1), np.sort(e.reshape(-1, 2, 2), axis=1)[:, :, ::-1]
    for k in np.array_split(np.flatnonzero(~out), max(1, (~out).sum() * len(e) // chunk)):
        c, m = np.nonzero((ends[None, :, 1] >= low[k, None]).all(axis=2) & (ends[None, :, 0] <= high[k, None]).all(axis=2))
        if not len(c):
            continue
        p, q = v[k[c]], e[m][:, None, [1, 0]]
        r, s = np.roll(p, -1, axis=1) - p, e[m][:, None, [3, 2]] - q
        cross = lambda a, b: a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
        d = cross(r, s)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(q - p, s) / d, cross(q - p, r) / d
        hit = ((d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any(axis=1)
        side = cross(r, q - p)  # a ring may lie within one cell: its corners are on one side of all four edges
        hit |= (side > 0).all(axis=1) | (side < 0).all(axis=1)
        out[k[c[hit]]] = True
    return out


def by_s2(edges: DataFrame, level: int, size: int) -> DataFrame:
    """Block centres per fence with their centre cell: blocks of size x size cells that meet the fence.

    A fence's bounds become coarse cells, each a row with the edges that its parities need; rows are
    refined independently, so that a large fence is spread over tasks. There is no limit on the cells.
    """
    coarse = max(0, level - REFINED)
    side, n = 1 << (s2.MAX_LEVEL - level), 1 << (level - coarse)
    span = side * size

    def coarser(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        e = g.sort_values(["ring", "seq"])[["ex1", "ey1", "ex2", "ey2"]].to_numpy(float)
        low, high = e.reshape(-1, 2).min(axis=0), e.reshape(-1, 2).max(axis=0)
        v = s2.vertices(s2.cell_ids(np.array([low[1], high[1]]), np.array([low[0], high[0]]), coarse))
        px, py = (v.max(axis=1) - v.min(axis=1)).max(axis=0)[::-1] / 4  # cells are curved: their corners' bounds may fall short
        cells = s2.cover_rect(low[1] - py, low[0] - px, high[1] + py, high[0] + px, coarse)
        v = s2.vertices(cells)
        y0, y1, x0, x1 = v[:, :, 0].min(1) - py, v[:, :, 0].max(1) + py, v[:, :, 1].min(1) - px, v[:, :, 1].max(1) + px
        ex, ey, rows = np.sort(e[:, [0, 2]], axis=1), np.sort(e[:, [1, 3]], axis=1), []
        for k in range(len(cells)):
            at = (ey[:, 1] >= y0[k]) & (ey[:, 0] <= y1[k]) & (ex[:, 1] >= x0[k])
            if (at & (ex[:, 0] <= x1[k])).any() or _parity(v[k : k + 1, 0], e[at])[0]:
                rows.append((key[0], int(cells[k]), e[at].ravel()))
        return pd.DataFrame(rows, columns=["fid", "coarse", "edges"])

    def refined(batches):
        a, b = (x.ravel() * side for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
        centre = lambda a: np.minimum(a // span * span + size // 2 * side, s2.SIZE - side)
        for g in batches:
            for fid, cell, flat in zip(g["fid"], g["coarse"], g["edges"], strict=True):
                face, i, j, _ = (int(x[0]) for x in s2.to_face_ij(np.array([cell])))
                e = np.asarray(flat, float).reshape(-1, 4)
                v = s2.vertices(s2.from_face_ij(np.full(len(a), face), i + a, j + b, level))
                step = max(1, 4_000_000 // len(e))
                meets = np.concatenate([_meeting(v[k : k + step], e) for k in range(0, len(v), step)])
                own = np.unique(s2.from_face_ij(np.full(meets.sum(), face), centre(i + a[meets]), centre(j + b[meets]), level))
                lat, lon = s2.centers(own)
                yield pd.DataFrame({"fid": np.full(len(own), fid), "lat": lat, "lon": lon, "cell": own})

    rows = dealt(edges, "fid").groupBy("fid").applyInPandas(coarser, "fid long, coarse long, edges array<double>")
    found = dealt(rows, "fid", "coarse").mapInPandas(refined, "fid long, lat double, lon double, cell long").dropDuplicates(["fid", "cell"])
    order = Window.partitionBy("fid").orderBy(s2.order_key(F.col("cell")))
    return found.select("fid", (F.row_number().over(order) - 1).cast("long").alias("seq"), "lat", "lon", "cell")


def tagged(tiles: DataFrame, fences: DataFrame, mode: str) -> DataFrame:
    """Tiles with the fence's name and id and a constant mode."""
    return tiles.join(fences.select("fid", F.col("name").alias("__name"), F.col("fid").alias("__geofence_id")), "fid").withColumn("__mode", F.lit(mode))
