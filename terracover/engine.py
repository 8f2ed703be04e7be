"""The calls of the service, as one facade over the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracover.functions import s2
from terracover.operators import bootstrap, cover, plugins, routing, stats
from terracover.operators.joins import in_any_fence, pip_join, radius_join, within_bounds

CLUSTER_MODES = ("fastest", *cover.GREEDY_MODES)
#: The same, for jobs of all modes: tasks that begin first should not be the shortest.
SLOWEST_FIRST = ("best", "balanced", "better", "fast", "honeycomb", "fastest")


@dataclass(frozen=True)
class Args:
    """Options with their defaults; out-of-range split levels are errors.

    cluster_mode and sort_by also take the name of a plugin: a registered function or a program of
    plugin_folder. max_clusters bounds each group that is covered greedily.
    """

    radius: float = 70.0
    min_points: int = 1
    cluster_mode: str = "balanced"
    sort_by: str = "unset"
    cluster_split_level: int = 0
    route_split_level: int = 0
    max_clusters: int = 0
    center_clusters: bool = False
    s2_level: int = 15
    s2_size: int = 9
    calculation_mode: str = "radius"
    density: int | None = None
    plugin_folder: str | None = None

    def __post_init__(self):
        own = plugins.listed(self.plugin_folder)
        if self.cluster_mode not in (*CLUSTER_MODES, *own["clustering"]) or self.sort_by not in (*routing.SORTS, *own["routing"]) or self.calculation_mode not in ("radius", "s2"):
            raise ValueError(f"unknown mode in {self}")
        if not (0 <= self.cluster_split_level <= 20 and 0 <= self.route_split_level <= 20 and self.radius > 0):
            raise ValueError(f"out of range in {self}")


def _split(level: int):
    return s2.cell(F.col("lat"), F.col("lon"), level) if level else None


def area_points(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, lat, lon, fid): the points in each fence."""
    return pip_join(within_bounds(points, edges), edges, ["id", "lat", "lon"])


def area_stats(points: DataFrame, edges: DataFrame) -> DataFrame:
    return area_points(points, edges).agg(F.countDistinct("id").alias("total"))


def clusters(points: DataFrame, edges: DataFrame, a: Args = Args()) -> DataFrame:
    """(fid, seq, lat, lon): the discs of each fence, in the order that sort_by asks for, from a best one on."""
    if a.calculation_mode == "s2":
        blocks = bootstrap.by_s2(edges, a.s2_level, a.s2_size)
        full = cover.s2_block_cover(in_any_fence(within_bounds(points, edges), edges), blocks, a.s2_level, a.s2_size, a.min_points)
        found = blocks.join(full, "cell", "left_semi").select("fid", "seq", "lat", "lon")
        return route(found, a, area_points(points, edges))
    inside = area_points(points, edges)
    split = _split(a.cluster_split_level)
    if a.cluster_mode == "fastest":
        found = cover.fastest_cover(inside, a.radius, a.min_points, split)
    elif a.cluster_mode in cover.GREEDY_MODES:
        found = cover.greedy_cover(inside, a.radius, a.min_points, a.cluster_mode, split, a.max_clusters, a.density)
    else:
        found = plugins.run(inside, "clustering", a.cluster_mode, "fid", split, folder=a.plugin_folder, radius=a.radius, min_points=a.min_points, max_clusters=a.max_clusters)
        found = found.select("fid", F.lit(0).alias("split"), F.col("seq").alias("cid"), "lat", "lon")
    found = found.select("fid", F.row_number().over(Window.partitionBy("fid").orderBy("split", "cid")).cast("long").alias("seq"), "lat", "lon")
    if a.center_clusters:
        found = centred(found, inside, a.radius)
    return route(found, a, inside)


def _keyed(stops: DataFrame) -> DataFrame:
    return stops.withColumn("cid", F.col("fid") * (1 << 32) + F.col("seq"))


def centred(found: DataFrame, inside: DataFrame, radius: float) -> DataFrame:
    """Discs moved onto the points of their own fence that they claim."""
    keyed = _keyed(found)
    pairs = radius_join(inside, keyed, radius, ["id"], ["cid"], on=("fid",))
    pairs = pairs.withColumn("id", F.struct("fid", "id"))  # a point of two fences is a point of each
    claims = cover.first_claims(pairs, pairs.groupBy("cid").agg(F.count("*").alias("n_all")))
    members = claims.join(inside.select(F.struct("fid", "id").alias("id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "id").select("cid", "p_lat", "p_lon")
    return cover.centred(keyed, members, radius).select(F.shiftright("cid", 32).alias("fid"), F.col("cid").bitwiseAND(F.lit((1 << 32) - 1)).alias("seq"), "lat", "lon")


def route(stops: DataFrame, a: Args = Args(), points: DataFrame | None = None) -> DataFrame:
    """Stops in the asked order; `tsp` splits by route_split_level.

    With the points (id, lat, lon, fid) of each fence, every order then starts at its last stop of those that
    cover the most of them; `pointcount` needs them.
    """
    covered = None
    if points is not None:
        pairs = radius_join(points, _keyed(stops), a.radius, ["id"], ["cid"], on=("fid",)).groupBy("cid").agg(F.count("*").alias("n_all"))
        covered = _keyed(stops).join(pairs, "cid", "left").withColumn("n_all", F.coalesce("n_all", F.lit(0))).drop("cid")
    if a.sort_by == "pointcount":
        if covered is None:
            raise ValueError("pointcount needs the points")
        out = routing.by_point_count(covered).drop("n_all")
    elif a.sort_by == "tsp":
        out = routing.by_tour(stops, _split(a.route_split_level))
    elif a.sort_by in routing.SORTS:
        out = routing.SORTS[a.sort_by](stops)
    else:
        out = plugins.run(routing.by_s2(stops), "routing", a.sort_by, "fid", _split(a.route_split_level), routing.joined, a.plugin_folder)
    if covered is None:
        return out
    best = covered.withColumn("top", F.max("n_all").over(Window.partitionBy("fid"))).where("n_all = top")
    return routing.rotated(out.select("fid", "seq", "lat", "lon"), best)


def bootstrapped(edges: DataFrame, a: Args = Args()) -> DataFrame:
    """(fid, seq, lat, lon): the tiles of each fence."""
    tiles = bootstrap.by_radius(edges, a.radius) if a.calculation_mode == "radius" else bootstrap.by_s2(edges, a.s2_level, a.s2_size)
    return route(tiles.select("fid", "seq", "lat", "lon"), a)


def route_stats(stops: DataFrame, points: DataFrame, a: Args = Args()) -> DataFrame:
    """One row: coverage and score of all stops, and the summed tour."""
    keyed = stops.select((F.col("fid") * (1 << 32) + F.col("seq")).alias("cid"), "lat", "lon")
    pairs = radius_join(points, keyed, a.radius, ["id"], ["cid"])
    tours = stats.tour(stops, "fid").agg(F.round(F.sum("total"), 3).alias("distance"), F.round(F.sum("longest"), 3).alias("longest"))
    return stats.coverage(pairs, keyed, points, a.min_points).crossJoin(tours)
