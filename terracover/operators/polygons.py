"""Polygon union per group, by splitting edges and keeping those on the outside.

`union_by` cuts and tests edges as rows: segments that share a grid cell are cut where they meet, both sides
of every piece are looked up in the polygons, and only the pieces of the outline meet in one task to be
joined end to end. `union` is the same on a few polygons at hand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracover.operators.formats import with_part
from terracover.operators.grouping import settled
from terracover.operators.joins import FENCE_CELLS, _levels, pip_join

PLACES = 9


def _cuts(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Positions on segment a-b at which segments p-q cross or touch it."""
    r, s = b - a, q - p
    d = r[0] * s[:, 1] - r[1] * s[:, 0]
    w = p - a
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / d, (w[:, 0] * r[1] - w[:, 1] * r[0]) / d
    hit = (np.abs(d) > 1e-18) & (u >= -1e-12) & (u <= 1 + 1e-12)
    square = (r * r).sum()
    flat = np.abs(d) <= 1e-18
    on = np.abs(w[:, 0] * r[1] - w[:, 1] * r[0]) <= 1e-12 * max(square, 1e-18) ** 0.5
    along = np.concatenate([((x - a) @ r / square)[flat & on] for x in (p, q)]) if square else np.zeros(0)
    out = np.r_[0.0, 1.0, t[hit], along]
    return np.unique(np.round(out[(out >= 0) & (out <= 1)], 12))


def _inside(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
    """Ray parity of one [x, y] point."""
    up = (start[:, 1] > x[1]) != (end[:, 1] > x[1])
    s, e = start[up], end[up]
    return bool(((x[0] < (e[:, 0] - s[:, 0]) * (x[1] - s[:, 1]) / (e[:, 1] - s[:, 1]) + s[:, 0]).sum()) % 2)


def union(polygons: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rings [x, y] of the union of polygons (lists of rings); holes come as rings of their own.

    Edges are cut where any others meet them. A piece stays if its two sides differ in being covered by
    any polygon; the pieces are then joined end to end with the covered side on the left.
    """
    sides = [(np.concatenate([r for r in p]), np.concatenate([np.roll(r, -1, axis=0) for r in p])) for p in polygons]
    start, end = np.concatenate([s for s, _ in sides]), np.concatenate([e for _, e in sides])
    kept: dict[tuple, tuple] = {}
    for a, b in zip(start, end, strict=True):
        if np.allclose(a, b, atol=1e-15):
            continue
        t = _cuts(a, b, start, end)
        for t0, t1 in zip(t, t[1:], strict=False):
            p, q = a + t0 * (b - a), a + t1 * (b - a)
            mid, normal = (p + q) / 2, np.array([-(q - p)[1], (q - p)[0]])
            step = normal / np.hypot(*normal) * 1e-9
            left, right = (any(_inside(mid + k * step, s, e) for s, e in sides) for k in (1, -1))
            if left != right:
                p, q = (tuple(np.round(x, PLACES).tolist()) for x in ((p, q) if left else (q, p)))
                if p != q:
                    kept[p, q] = (p, q)
    return _rings(kept)


def _rings(pieces) -> list[np.ndarray]:
    """The rings that directed pieces ((x, y), (x, y)) form, each from its least point on."""
    after: dict[tuple, list[tuple]] = {}
    for p, q in sorted(pieces):
        after.setdefault(p, []).append(q)
    rings = []
    while after:
        first = at = min(after)
        ring = []
        while True:
            ring.append(at)
            nxt = after[at].pop()
            if not after[at]:
                del after[at]
            at = nxt
            if at == first or at not in after:
                break
        if len(ring) > 2:
            rings.append(_straight(np.array(ring)))
    return rings


def _straight(ring: np.ndarray) -> np.ndarray:
    """Without points in the middle of straight runs."""
    a, b = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
    bend = np.abs((ring[:, 0] - a[:, 0]) * (b[:, 1] - ring[:, 1]) - (ring[:, 1] - a[:, 1]) * (b[:, 0] - ring[:, 0])) > 1e-15
    return ring[bend] if bend.sum() > 2 else ring


def area(ring: np.ndarray) -> float:
    """Signed planar area."""
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)


def _segments(edges: DataFrame, key: str) -> DataFrame:
    """(key, fid, sid, ax, ay, bx, by): the sides of all rings, without those of no length."""
    if "part" in edges.columns:
        edges = edges.withColumn("ring", F.struct("part", "ring"))
    ring = Window.partitionBy(key, "fid", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    out = edges.select(key, "fid", F.xxhash64(key, "fid", "ring", "seq").alias("sid"), F.col("ex1").alias("ax"), F.col("ey1").alias("ay"), nxt("ex1").alias("bx"), nxt("ey1").alias("by"))
    return out.where("abs(ax - bx) > 1e-15 or abs(ay - by) > 1e-15")


def _in_cells(segments: DataFrame, key: str) -> DataFrame:
    """Segments in the grid cells of their bounds; a key's longer side has about FENCE_CELLS cells."""
    low = lambda f: f(F.least("ax", "bx"))
    extent = F.greatest(F.max(F.greatest("ax", "bx")) - low(F.min), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by")))
    side = segments.groupBy(key).agg(F.greatest(extent / FENCE_CELLS, F.lit(1e-9)).alias("side"))
    at = lambda f, a, b: F.floor(f(a, b) / F.col("side"))
    over = lambda a, b: F.sequence(at(lambda x, y: F.least(x, y) - 1e-12, F.col(a), F.col(b)), at(lambda x, y: F.greatest(x, y) + 1e-12, F.col(a), F.col(b)))
    rows = segments.join(side, key).select("*", F.explode(over("ax", "bx")).alias("gx"))
    return rows.select("*", F.explode(over("ay", "by")).alias("gy")).drop("side")


def _cut_at() -> Column:
    """Where (from 0 to 1) segment a-b is cut by the other segment p-q: array of positions."""
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by", "px", "py", "qx", "qy")}
    rx, ry, sx, sy, wx, wy = c["bx"] - c["ax"], c["by"] - c["ay"], c["qx"] - c["px"], c["qy"] - c["py"], c["px"] - c["ax"], c["py"] - c["ay"]
    d, square, off = rx * sy - ry * sx, rx * rx + ry * ry, wx * ry - wy * rx
    crosses = (F.abs(d) > 1e-18) & (off / d).between(-1e-12, 1 + 1e-12)
    lies_on = (F.abs(d) <= 1e-18) & (F.abs(off) <= 1e-12 * F.sqrt(F.greatest(square, F.lit(1e-18))))
    along = lambda x, y: ((x - c["ax"]) * rx + (y - c["ay"]) * ry) / square
    found = F.when(crosses, F.array((wx * sy - wy * sx) / d)).when(lies_on, F.array(along(c["px"], c["py"]), along(c["qx"], c["qy"])))
    return F.transform(F.filter(found, lambda t: t.between(0, 1)), lambda t: F.round(t, 12))


def union_by(edges: DataFrame, key: str, drop_holes: bool = False) -> DataFrame:
    """(key, ring, seq, x, y): the union of the fences of each key; edges (key, fid, ring, seq, ex1, ey1, ...).

    Only the outline of a key's union meets in one task.
    """
    segments = _segments(edges, key)
    cells = _in_cells(segments, key)
    other = cells.select(key, "gx", "gy", F.col("sid").alias("other"), F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"))
    met = cells.join(other, [key, "gx", "gy"]).where("sid <> other and least(ax, bx) <= greatest(px, qx) + 1e-12 and least(px, qx) <= greatest(ax, bx) + 1e-12 and least(ay, by) <= greatest(py, qy) + 1e-12 and least(py, qy) <= greatest(ay, by) + 1e-12")
    cuts = met.select(key, "sid", F.explode(_cut_at()).alias("t")).groupBy(key, "sid").agg(F.collect_set("t").alias("ts"))
    ends = F.array(F.lit(0.0), F.lit(1.0))
    whole = segments.join(cuts, [key, "sid"], "left").withColumn("ts", F.array_sort(F.array_distinct(F.concat(ends, F.coalesce("ts", ends)))))
    between = F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda k: F.struct(F.get("ts", k - 1).alias("t0"), F.get("ts", k).alias("t1")))
    cut = whole.select(key, "sid", "ax", "ay", "bx", "by", F.inline(between))
    place = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    pieces = cut.select(key, "sid", "t0", place("ax", "bx", "t0").alias("px"), place("ay", "by", "t0").alias("py"), place("ax", "bx", "t1").alias("qx"), place("ay", "by", "t1").alias("qy"))
    # a point next to the middle on either side, and whether any of the key's polygons holds it
    length = F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))
    lon, lat = (F.col("px") + F.col("qx")) / 2 - F.col("s") * (F.col("qy") - F.col("py")) / length * 1e-9, (F.col("py") + F.col("qy")) / 2 + F.col("s") * (F.col("qx") - F.col("px")) / length * 1e-9
    sides = pieces.where(length > 0).select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("s")).select("*", lat.alias("lat"), lon.alias("lon"))
    one = F.xxhash64(key, "fid")  # a fence may belong to several keys
    held = pip_join(sides.select(F.col(key).alias("own"), "sid", "t0", "s", "lat", "lon"), segments.select(one.alias("fid"), F.col("ax").alias("ex1"), F.col("ay").alias("ey1"), F.col("bx").alias("ex2"), F.col("by").alias("ey2")), ["own", "sid", "t0", "s"])
    held = held.join(segments.select(F.col(key).alias("own"), one.alias("fid")).distinct(), ["own", "fid"]).groupBy(F.col("own").alias(key), "sid", "t0").agg(F.max("s").alias("left"), F.min("s").alias("right"))
    outline = pieces.join(held, [key, "sid", "t0"]).where(F.col("left") == F.col("right"))  # covered on one side only
    near = lambda c: F.round(c, PLACES)
    p, q = (near(F.col("px")), near(F.col("py"))), (near(F.col("qx")), near(F.col("qy")))
    turned = lambda a, b: F.when(F.col("left") == 1, a).otherwise(b)
    outline = outline.select(key, turned(p[0], q[0]).alias("x1"), turned(p[1], q[1]).alias("y1"), turned(q[0], p[0]).alias("x2"), turned(q[1], p[1]).alias("y2")).where("x1 <> x2 or y1 <> y2").distinct()

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        pieces = [((a, b), (c, d)) for a, b, c, d in zip(g["x1"].tolist(), g["y1"].tolist(), g["x2"].tolist(), g["y2"].tolist(), strict=True)]
        rings = [r for r in _rings(pieces) if not drop_holes or area(r) > 0]
        rows = [(k[0], i, j, *p) for i, r in enumerate(rings) for j, p in enumerate(r.tolist())]
        return pd.DataFrame(rows, columns=[key, "ring", "seq", "x", "y"])

    return outline.groupBy(key).applyInPandas(run, f"{key} long, ring long, seq long, x double, y double")


def _sided(edges: DataFrame) -> DataFrame:
    """(fid, ring, side, ax, ay, bx, by): the sides of all parts, with a name for each ring and side of a fence."""
    name = F.concat_ws(":", F.col("part").cast("string"), F.col("ring").cast("string"))
    own = with_part(edges).where("abs(ex1 - ex2) > 1e-15 or abs(ey1 - ey2) > 1e-15")
    return own.select("fid", name.alias("ring"), F.concat_ws(":", name, F.col("seq").cast("string")).alias("side"), F.col("ex1").alias("ax"), F.col("ey1").alias("ay"), F.col("ex2").alias("bx"), F.col("ey2").alias("by"))


def _edges(sides: DataFrame) -> DataFrame:
    return sides.select("fid", F.col("ax").alias("ex1"), F.col("ay").alias("ey1"), F.col("bx").alias("ex2"), F.col("by").alias("ey2"))


def intersecting(a: DataFrame, b: DataFrame, step: float = 0.005) -> DataFrame:
    """(a, b): the fences of two edge tables that share area; holes and several parts count as they are.

    Fences have at most some 64 x 64 grid cells, whatever their size; sides meet in the cells of the larger of
    two fences. Where sides touch, cross or overlap they are cut, and the pair shares area if a point next to a
    piece, on either side, lies in both fences. A ring that touches none of the other fence's sides lies in it or
    outside as a whole: one of its points tells.
    """
    sa, sb = _sided(a), _sided(b)
    la, lb = _levels(_edges(sa), step), _levels(_edges(sb), step)
    levels = sorted({*la[1], *lb[1]})
    if not la[1] or not lb[1]:
        return sa.select(F.col("fid").alias("a"), F.col("fid").alias("b")).limit(0)

    def dealt(sides: DataFrame, of: DataFrame, p: str) -> DataFrame:
        own = sides.join(of, "fid").select(*(F.col(c).alias(f"{p}_{c}") for c in ("fid", "ring", "side", "ax", "ay", "bx", "by", "level")))
        rows = own.select("*", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(f"{p}_level"))).alias("level"))
        width = F.lit(step) * F.pow(F.lit(2.0), F.col("level"))
        over = lambda u, v: F.sequence(F.floor((F.least(u, v) - 1e-12) / width), F.floor((F.greatest(u, v) + 1e-12) / width))
        return rows.select("*", F.explode(over(F.col(f"{p}_ax"), F.col(f"{p}_bx"))).alias("gx")).select("*", F.explode(over(F.col(f"{p}_ay"), F.col(f"{p}_by"))).alias("gy"))

    near = dealt(sa, la[0], "a").join(dealt(sb, lb[0], "b"), ["level", "gx", "gy"]).where("a_level = level or b_level = level")
    apart = [f"least(a_{c[0]}, a_{c[1]}) > greatest(b_{c[0]}, b_{c[1]}) + 1e-12 or least(b_{c[0]}, b_{c[1]}) > greatest(a_{c[0]}, a_{c[1]}) + 1e-12" for c in (("ax", "bx"), ("ay", "by"))]
    near = near.where(f"not ({' or '.join(apart)})").drop("level", "gx", "gy", "a_level", "b_level").distinct()

    def cuts(own: str, other: str) -> DataFrame:
        """Where each side of one table is cut by those of the other's fences that it meets."""
        names = {f"{own}_{k}": k for k in ("ax", "ay", "bx", "by")} | {f"{other}_{k}": n for k, n in (("ax", "px"), ("ay", "py"), ("bx", "qx"), ("by", "qy"))}
        rows = near.select("a_fid", "b_fid", F.col(f"{own}_ring").alias("ring"), F.col(f"{own}_side").alias("side"), *(F.col(k).alias(n) for k, n in names.items()))
        return rows.select("a_fid", "b_fid", "ring", "side", "ax", "ay", "bx", "by", F.explode(_cut_at()).alias("t"))

    # a side that another's end lies on is cut there, the other at its end: each contact is seen from both
    met = settled(cuts("a", "b").withColumn("of", F.lit("a")).unionByName(cuts("b", "a").withColumn("of", F.lit("b"))))
    ends = F.array(F.lit(0.0), F.lit(1.0))
    whole = met.groupBy("a_fid", "b_fid", "of", "side", "ax", "ay", "bx", "by").agg(F.array_sort(F.array_distinct(F.concat(ends, F.collect_set("t")))).alias("ts"))
    middle = F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda k: (F.get("ts", k - 1) + F.get("ts", k)) / 2)
    pieces = whole.select("a_fid", "b_fid", "ax", "ay", "bx", "by", F.explode(middle).alias("t"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    beside = pieces.select("*", F.explode(F.array(F.lit(1e-9), F.lit(-1e-9))).alias("s"))
    points = beside.select("a_fid", "b_fid", (F.col("ay") + F.col("t") * dy + F.col("s") * dx / F.hypot(dx, dy)).alias("lat"), (F.col("ax") + F.col("t") * dx - F.col("s") * dy / F.hypot(dx, dy)).alias("lon"))
    points = points.withColumn("p", F.struct("lat", "lon"))
    keys = ["a_fid", "b_fid", "p"]
    in_a = pip_join(points, _edges(sa), keys, step, la).where("fid = a_fid").drop("fid")
    in_b = pip_join(points, _edges(sb), keys, step, lb).where("fid = b_fid").drop("fid")
    touching = in_a.join(in_b, keys, "left_semi").select(F.col("a_fid").alias("a"), F.col("b_fid").alias("b"))

    def within(sides: DataFrame, other: DataFrame, known: tuple[DataFrame, list[int]], own: str, theirs: str) -> DataFrame:
        """Fences with a ring inside a fence of the other table, free of its sides."""
        one = sides.groupBy("fid", "ring").agg(F.min(F.struct("side", "ax", "ay")).alias("m"))
        seed = one.select(F.col("fid").alias(f"{own}_fid"), "ring", F.col("m.ay").alias("lat"), F.col("m.ax").alias("lon"))
        found = pip_join(seed, _edges(other), [f"{own}_fid", "ring"], step, known).withColumnRenamed("fid", f"{theirs}_fid")
        free = found.join(met.where(F.col("of") == own).select("a_fid", "b_fid", "ring").distinct(), ["a_fid", "b_fid", "ring"], "left_anti")
        return free.select(F.col("a_fid").alias("a"), F.col("b_fid").alias("b"))

    return touching.unionByName(within(sa, sb, lb, "a", "b")).unionByName(within(sb, sa, la, "b", "a")).distinct()
