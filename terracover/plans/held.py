"""Queries that hold covers, tours and tilings to what must be true of any of them, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracover import engine
from terracover.functions import s2
from terracover.operators import bootstrap, cover, routing, stats
from terracover.operators.grouping import settled
from terracover.operators.joins import edge_distances, pip_join, radius_join
from terracover.plans.registry import Views, inside, query
from terracover.plans.spatial import LEG, RING, over

RADIUS, MIN_POINTS = 70.0, 3
INSIDE = inside("spawnpoint")


def _inside(v: Views):
    return pip_join(v.spawnpoint, v.edge, ["id", "lat", "lon"])


@query("spawnpoint edge", f"SELECT fid, count(*) AS covered FROM ({INSIDE}) GROUP BY fid")
def q_held_cover_all(v: Views):
    """With one point a disc enough, every point of every fence is covered."""
    points = _inside(v)
    found = cover.greedy_cover(points, RADIUS, 1, "fast").select("fid", "cid", "lat", "lon")
    pairs = radius_join(points, found, RADIUS, ["id"], ["cid"], on=("fid",))
    return pairs.select("fid", "id").distinct().groupBy("fid").agg(F.count("*").alias("covered"))


_MODES = ", ".join(f"('{m}')" for m in engine.CLUSTER_MODES)


#: Buckets of some 55 m, so that a disc near a bucket's middle holds it whole: a greedy cover leaves at most two of its points.
_BUCKET = "floor(lat * 2000), floor(lon * 1500)"


@query("spawnpoint edge", f"SELECT mode, points, least, 0 AS poor, 0 AS far, true AS scored, true AS enough FROM (SELECT CAST(sum(n) AS BIGINT) AS points, CAST(sum(greatest(n - 2, 0)) AS BIGINT) AS least FROM (SELECT fid, count(*) AS n FROM ({INSIDE}) GROUP BY fid, {_BUCKET})), (VALUES {_MODES}) AS m(mode)")
def q_held_cover_modes(v: Views):
    """Per mode: no greedy disc with fewer points of its own than asked for, none far from its fence's points, covered counts as
    joined anew, and enough points covered: all but two of each bucket (modes without candidates everywhere: half as many)."""
    points = settled(_inside(v))
    out = None
    sizes = points.groupBy("fid", F.floor(F.col("lat") * 2000).alias("y"), F.floor(F.col("lon") * 1500).alias("x")).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("points"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("least"))
    covers = None
    for mode in engine.SLOWEST_FIRST:  # in one job, so that no mode waits for the last fence of another
        found = cover.fastest_cover(points, RADIUS, MIN_POINTS) if mode == "fastest" else cover.greedy_cover(points, RADIUS, MIN_POINTS, mode)
        found = found.withColumn("mode", F.lit(mode))
        covers = found if covers is None else covers.unionByName(found)
    covers = settled(covers.repartition(len(engine.CLUSTER_MODES), "mode"))  # few rows, which are read again for each mode
    for mode in engine.CLUSTER_MODES:
        found = covers.where(F.col("mode") == mode).drop("mode")
        discs = found.withColumn("cid", F.struct("fid", "cid"))
        pairs = radius_join(points, discs, RADIUS, ["id"], ["cid"], on=("fid",)).withColumn("id", F.struct("fid", "id"))
        counts = stats.cluster_counts(pairs, discs)
        poor = F.count_if(F.col("n_unique") < MIN_POINTS) if mode != "fastest" else F.lit(0)
        each = counts.agg(poor.cast("int").alias("poor"), F.count_if(F.col("n_all") == 0).cast("int").alias("far"))
        covered = pairs.select("id").distinct().groupBy("id.fid").agg(F.count("*").alias("n"))
        told = found.groupBy("fid").agg(F.max("covered").alias("told")).join(covered, "fid", "full")
        told = told.agg(F.coalesce(F.every(F.coalesce("told", F.lit(0)) == F.coalesce("n", F.lit(0))), F.lit(True)).alias("scored"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))
        share = 0.5 if mode in ("fastest", "honeycomb") else 1.0
        one = whole.crossJoin(each).crossJoin(told).select(F.lit(mode).alias("mode"), "points", "least", "poor", "far", "scored", (F.col("covered") >= F.col("least") * share).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


_KINDS = ("tour", "split", "s2", "random", "geohash", "latlon")


@query("stop_in_fence", f"SELECT kind, fid, count(*) AS stops, 0 AS first, count(*) - 1 AS last, round(sum(lat), 6) AS lat, round(sum(lon), 6) AS lon FROM stop_in_fence, (VALUES {', '.join(f'({k!r})' for k in _KINDS)}) AS k(kind) GROUP BY kind, fid")
def q_held_orders(v: Views):
    """Every order is a permutation of the stops, numbered from 0."""
    stops = v.stop_in_fence.select("fid", F.col("pk").alias("seq"), "lat", "lon")
    made = {
        "tour": routing.by_tour(stops), "split": routing.by_tour(stops, s2.cell(F.col("lat"), F.col("lon"), 15)), "s2": routing.by_s2(stops),
        "random": routing.by_random(stops), "geohash": routing.by_geohash(stops), "latlon": routing.by_lat_lon(stops),
    }
    out = None
    for kind in _KINDS:
        one = made[kind].groupBy("fid").agg(F.countDistinct("seq").alias("stops"), F.min("seq").cast("int").alias("first"), F.max("seq").cast("long").alias("last"), F.round(F.sum("lat"), 6).alias("lat"), F.round(F.sum("lon"), 6).alias("lon")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("spawnpoint edge", f"SELECT fid, count(*) AS held FROM ({INSIDE}) GROUP BY fid")
def q_held_boot_s2(v: Views):
    """Every point of a fence lies in one of the fence's blocks."""
    blocks = bootstrap.by_s2(v.edge, 17, 1).select("fid", "cell")
    own = _inside(v).withColumn("cell", s2.cell(F.col("lat"), F.col("lon"), 17))
    return own.join(blocks, ["fid", "cell"]).groupBy("fid").agg(F.count("*").alias("held"))


@query("fence", "SELECT fid, 0 AS outside, true AS numbered FROM fence")
def q_held_boot_radius(v: Views):
    """Every tile lies in its fence or within a radius of its sides, and tiles are numbered from 0."""
    tiles = bootstrap.by_radius(v.edge, RADIUS)
    near = edge_distances(tiles.withColumn("own", F.col("fid")).drop("fid"), v.edge, ["own", "seq"], RADIUS).where("own = fid").select("fid", "seq")
    held = pip_join(tiles.withColumn("own", F.col("fid")).drop("fid"), v.edge, ["own", "seq"]).where("own = fid").select("fid", "seq")
    good = near.union(held).distinct().withColumn("good", F.lit(1))
    each = tiles.join(good, ["fid", "seq"], "left")
    return each.groupBy("fid").agg(F.count_if(F.col("good").isNull()).cast("int").alias("outside"), (F.max("seq") == F.count("*") - 1).alias("numbered"))


@query("spawnpoint edge", f"SELECT count(*) AS points, count(*) AS total FROM (SELECT DISTINCT id FROM ({INSIDE}))")
def q_held_score(v: Views):
    """The score's identity: score - clusters * min_points + covered is the number of points."""
    a = engine.Args(min_points=MIN_POINTS, cluster_mode="fastest", sort_by="pointcount")
    points = _inside(v).dropDuplicates(["id"])
    s = engine.route_stats(engine.clusters(v.spawnpoint, v.edge, a), points, a)
    return s.select((F.col("score") - F.col("clusters") * MIN_POINTS + F.col("covered")).alias("points"), "total")


@query("wide", "SELECT count(*) AS covered, 0 AS poor FROM wide")
def q_held_cover_tiled(v: Views):
    """Tiles cover every point where one point a disc is enough; where three are, no disc has fewer of its own."""
    one, three = cover.tiled_cover(v.wide, RADIUS, 1, "fast"), cover.tiled_cover(v.wide, RADIUS, MIN_POINTS, "fast")
    pairs = radius_join(v.wide, three, RADIUS, ["id"], ["cid"], on=("fid",))
    poor = stats.cluster_counts(pairs, three).agg(F.count_if(F.col("n_unique") < MIN_POINTS).cast("int").alias("poor"))
    return radius_join(v.wide, one, RADIUS, ["id"], ["cid"], on=("fid",)).agg(F.countDistinct("id").alias("covered")).crossJoin(poor)


@query("route_point", over(RING, f"SELECT fid, count(*) AS stops, round(sum({LEG}), 0) AS rows_length, true AS short FROM leg GROUP BY fid HAVING count(*) > 8"))
def q_held_tours(v: Views):
    """Tours of more than 20 stops are shorter than four fifths of the walk from north to south, whose length is here too; small ones are no longer."""
    walk = stats.tour(v.route_point, "fid", also=[F.count("*").alias("stops")]).where("stops > 8")
    tours = stats.tour(routing.by_tour(v.route_point.select("fid", "seq", "lat", "lon")), "fid").select("fid", F.col("total").alias("own"))
    return walk.join(tours, "fid").select("fid", "stops", F.round("total", 0).alias("rows_length"), (F.col("own") <= F.col("total") * F.when(F.col("stops") > 20, 0.8).otherwise(1.001)).alias("short"))
