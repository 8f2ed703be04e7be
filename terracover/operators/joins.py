"""Spatial joins as grid-bucketed equi-joins with an exact recheck."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.functions import geo
from terracover.operators.grouping import fresh, settled


def _turns(band: Column, step: float) -> Column:
    """How many equal longitude buckets go around the Earth in a latitude band: none narrower than the step's metres."""
    top = (F.abs(band.cast("double")) + 1.0) * F.lit(step)
    return F.when(top < 89.0, F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(top)) / F.lit(step)))).otherwise(F.lit(1)).cast("long")


def _slot(lon: Column, turns: Column) -> Column:
    return F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) / F.lit(360.0) * turns), turns)


def radius_join(points: DataFrame, centers: DataFrame, metres: float, point_key: list[str], center_key: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """point_key, center_key, on and `metres` of every pair within a distance (inclusive) that agrees on the columns `on`.

    Points fall into one latitude band and longitude bucket; a centre probes the buckets that its disc
    can reach in the bands around it; both sides are sorted and merged, neither is broadcast. Bands have their own bucket width, so both sides agree at any
    latitude; buckets go around at 180 degrees, and next to a pole a band is one bucket. Pairs are
    rechecked by the great-circle distance. Null coordinates join with nothing.
    """
    step = math.degrees(metres / geo.GRID_RADIUS) * 1.001
    band = F.floor(F.col("lat") / F.lit(step))
    place = lambda s: [x.alias(f"{s}_{n}") for n, x in zip("xyz", geo.unit_vector(F.col(f"{s}_lat"), F.col(f"{s}_lon")), strict=True)]
    p = points.select(*point_key, *on, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), band.alias("band"), _slot(F.col("lon"), _turns(band, step)).alias("slot"))
    p = p.select("*", *place("p"))
    c = centers.select(*center_key, *on, F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    c = c.select("*", *place("c"), F.explode(F.sequence(F.floor(F.col("c_lat") / F.lit(step)) - 1, F.floor(F.col("c_lat") / F.lit(step)) + 1)).alias("band"))
    turns = _turns(F.col("band"), step)
    own = _slot(F.col("c_lon"), turns)
    c = c.select("*", F.explode(F.array_distinct(F.array(*(F.pmod(own + k, turns) for k in (-1, 0, 1))))).alias("slot"))
    d = geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("c_lat"), F.col("c_lon"))
    # chords settle all pairs but those next to the rim, which great circles do
    rim = 2 * math.sin(min(metres / geo.MEAN_RADIUS, math.pi) / 2)
    slack = max(1e-6, 1e-13 / max(rim, 1e-13))
    apart = lambda n: (F.col(f"p_{n}") - F.col(f"c_{n}")) * (F.col(f"p_{n}") - F.col(f"c_{n}"))
    chord = apart("x") + apart("y") + apart("z")
    near = (chord <= F.lit(rim * rim * (1 - slack))) | ((chord <= F.lit(rim * rim * (1 + slack))) & (d <= F.lit(metres)))
    # c has up to nine rows a centre, which Spark does not see when it sizes a table: unasked it would broadcast all of them
    return p.join(c.hint("merge"), ["band", "slot", *on]).where(near).select(*point_key, *center_key, *on, d.alias("metres"))


def fence_cover(edges: DataFrame, step: float) -> DataFrame:
    """(fid, gx, gy, edges): grid cells of each fence's bounding box, with its edges as one array."""
    fences = edges.groupBy("fid").agg(
        F.min(F.least("ex1", "ex2")).alias("x0"), F.max(F.greatest("ex1", "ex2")).alias("x1"), F.min(F.least("ey1", "ey2")).alias("y0"), F.max(F.greatest("ey1", "ey2")).alias("y1"),
        F.collect_list(F.struct("ex1", "ey1", "ex2", "ey2")).alias("edges"),
    )
    cell = lambda c: F.floor(F.col(c) / F.lit(step))
    rows = fences.select("*", F.explode(F.sequence(cell("x0"), cell("x1"))).alias("gx"))
    return rows.select("*", F.explode(F.sequence(cell("y0"), cell("y1"))).alias("gy"))


#: Cells along the longer side of a fence's bounds, at most; and boxes that are pushed to a scan, along each side.
FENCE_CELLS, BOXES = 64, 8


def _levels(edges: DataFrame, step: float) -> tuple[DataFrame, list[int]]:
    """(fid, level): how often a fence doubles the cell's side; and the levels that occur (at most 17)."""
    extent = F.greatest(F.max(F.greatest("ex1", "ex2")) - F.min(F.least("ex1", "ex2")), F.max(F.greatest("ey1", "ey2")) - F.min(F.least("ey1", "ey2")))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(step)) / F.lit(FENCE_CELLS * step)))).cast("int")
    fences = edges.groupBy("fid").agg(level.alias("level"))
    return fences, sorted(fences.agg(F.collect_set("level")).first()[0])


def fence_cells(edges: DataFrame, fences: DataFrame, step: float) -> DataFrame:
    """(level, gx, gy, fid, odd, edges): the grid cells in which points may lie inside a fence, each with what parity needs.

    A cell keeps the edges that a ray from one of its points to the east may meet or miss; of the edges
    to its east that cross its whole height only the parity is kept (odd). Cells outside have no row,
    cells inside no edges, so that a fence of many edges is not copied whole into its cells.
    """
    side = F.lit(step) * F.pow(F.lit(2.0), F.col("level"))
    e = edges.join(fences, "fid").select("fid", "level", side.alias("side"), "ex1", "ey1", "ex2", "ey2")
    e = e.select("*", F.explode(F.sequence(F.floor(F.least("ey1", "ey2") / F.col("side")), F.floor(F.greatest("ey1", "ey2") / F.col("side")))).alias("gy"))
    rows = e.groupBy("fid", "level", "side", "gy").agg(
        F.collect_list(F.struct("ex1", "ey1", "ex2", "ey2")).alias("row"), F.min(F.least("ex1", "ex2")).alias("x0"), F.max(F.greatest("ex1", "ex2")).alias("x1")
    )
    cells = rows.select("*", F.explode(F.sequence(F.floor(F.col("x0") / F.col("side")), F.floor(F.col("x1") / F.col("side")))).alias("gx"))
    margin = F.col("side") * 1e-6
    west, south = F.col("gx") * F.col("side") - margin, F.col("gy") * F.col("side") - margin
    east, north = west + F.col("side") + 2 * margin, south + F.col("side") + 2 * margin
    spans = lambda x: (F.least(x["ey1"], x["ey2"]) <= south) & (F.greatest(x["ey1"], x["ey2"]) > north) & (F.least(x["ex1"], x["ex2"]) > east)
    meets = lambda x: (F.greatest(x["ex1"], x["ex2"]) >= west) & ~spans(x)
    out = cells.select("level", "gx", "gy", "fid", (F.size(F.filter("row", spans)) % 2 == 1).alias("odd"), F.filter("row", meets).alias("edges"))
    return out.where(F.col("odd") | (F.size("edges") > 0))


def _parity(lat: Column, lon: Column, odd: Column, edges: Column) -> Column:
    crossings = F.size(F.filter(edges, lambda e: geo.ray_crosses(lat, lon, e["ex1"], e["ey1"], e["ex2"], e["ey2"])))
    return (crossings + odd.cast("int")) % 2 == 1


def pip_join(points: DataFrame, edges: DataFrame, keep: list[str], step: float = 0.005, known: tuple[DataFrame, list[int]] | None = None) -> DataFrame:
    """(keep..., fid) of every point inside a fence: an equi-join of cells, then ray parity over the cell's edges.

    A fence's cells are `step` degrees wide, doubled until its bounds have at most FENCE_CELLS a side, so
    points look into one cell for each width that occurs. Holes and several parts follow from parity.
    Points on no fence, and null coordinates, drop out. known: the fences' levels, where they are worked out already.
    """
    fences, levels = known or _levels(edges, step)
    cells = fence_cells(edges, fences, step)
    side = F.lit(step) * F.pow(F.lit(2.0), F.col("level"))
    p = points.select(*keep, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.explode(F.array(*map(F.lit, levels)) if levels else F.lit(None).cast("array<int>")).alias("level"))
    p = p.withColumn("gx", F.floor(F.col("p_lon") / side)).withColumn("gy", F.floor(F.col("p_lat") / side))
    near = p.join(cells, ["level", "gx", "gy"])
    return near.where(_parity(F.col("p_lat"), F.col("p_lon"), F.col("odd"), F.col("edges"))).select(*keep, "fid")


def within_bounds(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The points near the fences, as literal ranges that reach a Parquet scan.

    The bounds of all fences, and of the fences of each of BOXES x BOXES parts of them, come to the driver;
    row groups outside are then never read where points are stored by place.
    """
    box = lambda f, g, a, b: f(g(a, b))
    sides = [box(F.min, F.least, "ex1", "ex2").alias("x0"), box(F.max, F.greatest, "ex1", "ex2").alias("x1"), box(F.min, F.least, "ey1", "ey2").alias("y0"), box(F.max, F.greatest, "ey1", "ey2").alias("y1")]
    fences = edges.groupBy("fid").agg(*sides)
    b = fences.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    if b[0] is None:
        return points.where("false")
    part = lambda c, low, high: F.floor((F.col(c) - low) / max(high - low, 1e-9) * BOXES * 0.999999)
    boxes = fences.groupBy(part("x0", b[0], b[1]).alias("px"), part("y0", b[2], b[3]).alias("py")).agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).orderBy("px", "py").collect()
    within = lambda x0, x1, y0, y1: (F.col("lon") >= x0) & (F.col("lon") <= x1) & (F.col("lat") >= y0) & (F.col("lat") <= y1)
    return points.where(within(*b)).where(functools.reduce(operator.or_, (within(*x[2:]) for x in boxes)))


def in_any_fence(points: DataFrame, edges: DataFrame, step: float = 0.005, inside: bool = True) -> DataFrame:
    """The points inside at least one fence (or in none), each row once, in one pass: all fences of a cell come as one array."""
    fences, levels = _levels(edges, step)
    cells = fence_cells(edges, fences, step).groupBy("level", "gx", "gy").agg(F.collect_list(F.struct("odd", "edges")).alias("fences"))
    lat, lon = fresh(points, "lat_"), fresh(points, "lon_")
    out, found = points.withColumn(lat, F.col("lat")).withColumn(lon, F.col("lon")), F.lit(False)
    for k in levels:
        side, gx, gy, own = F.lit(step * 2.0**k), fresh(points, "gx"), fresh(points, "gy"), fresh(points, f"fences{k}")
        here = cells.where(F.col("level") == k).select(F.col("gx").alias(gx), F.col("gy").alias(gy), F.col("fences").alias(own))
        out = out.withColumn(gx, F.floor(F.col(lon) / side)).withColumn(gy, F.floor(F.col(lat) / side)).join(here, [gx, gy], "left").drop(gx, gy)
        found = found | F.coalesce(F.exists(own, lambda f: _parity(F.col(lat), F.col(lon), f["odd"], f["edges"])), F.lit(False))
    return out.where(found if inside else ~found).select(points.columns)


def edge_distances(points: DataFrame, edges: DataFrame, key: list[str], metres: float) -> DataFrame:
    """(key..., fid, metres): how far each point is from the sides of every fence within a distance.

    Sides are dealt to the grid cells that lie within the distance of their bounds; a point looks into one.
    """
    step = math.degrees(metres / geo.GRID_RADIUS) * 1.001
    high = F.least(F.lit(89.0), F.greatest(F.abs("ey1"), F.abs("ey2")) + F.lit(step))
    wide = F.lit(step) / F.cos(F.radians(high))
    cells = lambda a, b, by: F.sequence(F.floor((F.least(a, b) - by) / step), F.floor((F.greatest(a, b) + by) / step))
    e = edges.select("fid", "ex1", "ey1", "ex2", "ey2", F.explode(cells("ey1", "ey2", F.lit(step))).alias("gy"), wide.alias("wide"))
    e = e.select("*", F.explode(cells("ex1", "ex2", F.col("wide"))).alias("gx")).drop("wide")
    p = points.select(*key, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.floor(F.col("lat") / step).alias("gy"), F.floor(F.col("lon") / step).alias("gx"))
    d = geo.segment_distance(F.col("p_lat"), F.col("p_lon"), F.col("ey1"), F.col("ex1"), F.col("ey2"), F.col("ex2"))
    return p.join(e, ["gx", "gy"]).select(*key, "fid", d.alias("metres")).where(F.col("metres") <= metres).groupBy(*key, "fid").agg(F.min("metres").alias("metres"))


def nearest_pairs(tours: DataFrame) -> DataFrame:
    """For each tour (key, next_key) the closest pair of stops: tours(key, next_key, a_seq, a_lat, a_lon, b_seq, b_lat, b_lon)."""
    d = geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return tours.groupBy("key", "next_key").agg(F.min(F.struct(d.alias("metres"), "a_seq", "b_seq")).alias("m")).select("key", "next_key", "m.a_seq", "m.b_seq", F.round("m.metres", 3).alias("metres"))


#: Boxes along each side of a tour's bounds, first and then in each of those, by which pairs of stops are ruled out.
TOUR_BOXES = (16, 8)


def nearest_between(a: DataFrame, b: DataFrame) -> DataFrame:
    """nearest_pairs of stops a (key, next_key, a_seq, a_lat, a_lon) and b (next_key, b_seq, b_lat, b_lon) without all their pairs.

    Each tour's stops fall into boxes. Boxes that are farther from each other than some two stops of the tours drop
    out, then boxes inside those that remain; stops meet for the boxes that are left. A place without coordinates has no distance.
    """
    coarse, fine = TOUR_BOXES[0], TOUR_BOXES[0] * TOUR_BOXES[1]

    def boxed(df: DataFrame, by: str, s: str) -> DataFrame:
        lat, lon = f"{s}_lat", f"{s}_lon"
        df = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        box = df.groupBy(by).agg(F.min(lat).alias("y0"), F.max(lat).alias("y1"), F.min(lon).alias("x0"), F.max(lon).alias("x1"))
        at = lambda c, lo, hi, n: F.floor((F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-12)) * (n * 0.999999))
        cell = lambda n: (at(lat, "y0", "y1", n) * n + at(lon, "x0", "x1", n)).cast("int")
        return df.join(box, by).withColumn(f"{s}_fine", cell(fine)).withColumn(f"{s}_box", cell(coarse)).drop("y0", "y1", "x0", "x1")

    def bounds(df: DataFrame, s: str, *by: str) -> DataFrame:
        lat, lon = f"{s}_lat", f"{s}_lon"
        return df.groupBy(*by).agg(F.min(lat).alias(f"{s}y0"), F.max(lat).alias(f"{s}y1"), F.min(lon).alias(f"{s}x0"), F.max(lon).alias(f"{s}x1"), F.min(F.struct(lat, lon)).alias(f"{s}p"))

    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"))
    turn = F.greatest(F.lit(0.0), F.lit(360.0) - (F.greatest("ax1", "bx1") - F.least("ax0", "bx0")))
    flat = lambda s: F.cos(F.radians(F.greatest(F.abs(f"{s}y0"), F.abs(f"{s}y1"))))
    half = lambda c: F.pow(F.sin(F.radians(c) / 2), 2)
    least = 2 * geo.MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(half(gap("y")) + flat("a") * flat("b") * half(F.least(gap("x"), turn)))))
    some = geo.haversine(F.col("ap.a_lat"), F.col("ap.a_lon"), F.col("bp.b_lat"), F.col("bp.b_lon"))

    def near(pairs: DataFrame, *keep: str) -> DataFrame:
        pairs = settled(pairs.select("key", "next_key", *keep, least.alias("least"), some.alias("some")))
        most = pairs.groupBy("key", "next_key").agg(F.min("some").alias("most"))
        return pairs.join(most, ["key", "next_key"]).where(F.col("least") * (1 - 1e-9) - 1e-6 <= F.col("most")).select("key", "next_key", *keep)

    a, b = settled(boxed(a, "key", "a")), settled(boxed(b, "next_key", "b"))
    first = near(bounds(a, "a", "key", "next_key", "a_box").join(bounds(b, "b", "next_key", "b_box"), "next_key"), "a_box", "b_box")
    inner = first.join(bounds(a, "a", "key", "next_key", "a_box", "a_fine"), ["key", "next_key", "a_box"]).join(bounds(b, "b", "next_key", "b_box", "b_fine"), ["next_key", "b_box"])
    second = near(inner, "a_fine", "b_fine")
    return nearest_pairs(second.join(a, ["key", "next_key", "a_fine"]).join(b, ["next_key", "b_fine"]))
