"""Coverage and tour statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracover.functions import geo
from terracover.operators.formats import with_part
from terracover.operators.grouping import highest_before


def cluster_counts(pairs: DataFrame, clusters: DataFrame, cluster: str = "cid", point: str = "id") -> DataFrame:
    """(cluster, n_all, n_unique): covered points, and those that no other cluster covers.

    Pairs are counted by cluster and by point where they arise, so that no pair is shuffled.
    """
    counts = pairs.groupBy(cluster).agg(F.count("*").alias("n_all"))
    alone = pairs.groupBy(point).agg(F.count("*").alias("covers"), F.min(cluster).alias(cluster)).where("covers = 1").groupBy(cluster).agg(F.count("*").alias("n_unique"))
    out = clusters.select(cluster).join(counts, cluster, "left").join(alone, cluster, "left")
    return out.select(cluster, F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """(size, clusters): how many clusters have each size."""
    return counts.groupBy(F.col(column).alias("size")).agg(F.count("*").alias("clusters"))


def best(counts: DataFrame) -> DataFrame:
    """The clusters that cover the most points."""
    return counts.crossJoin(counts.agg(F.max("n_all").alias("best"))).where("n_all = best").drop("best")


def worst(counts: DataFrame, order: str) -> DataFrame:
    """(worst, clusters): least size and its multiplicity among clusters below the best seen before them; 0 if none.

    The order is part of the statistic: a running maximum, in buckets of the order.
    """
    below = highest_before(counts, order, "n_all", "before").where("n_all < before").groupBy("n_all").agg(F.count("*").alias("n"))
    return below.agg(F.min(F.struct("n_all", "n")).alias("m")).select(F.coalesce("m.n_all", F.lit(0)).alias("worst"), F.coalesce("m.n", F.lit(0)).alias("clusters"))


def coverage(pairs: DataFrame, clusters: DataFrame, points: DataFrame, min_points: int, point: str = "id") -> DataFrame:
    """(clusters, total, covered, score): score = clusters * min_points + uncovered; lower is better."""
    one = clusters.agg(F.count("*").alias("clusters")).crossJoin(points.agg(F.count("*").alias("total"))).crossJoin(pairs.agg(F.countDistinct(point).alias("covered")))
    return one.withColumn("score", F.col("clusters") * min_points + F.col("total") - F.col("covered"))


def tour(stops: DataFrame, key: str | None = None, seq: str = "seq", also: list[Column] | None = None) -> DataFrame:
    """([key], total, longest, also...): closed-ring length and its longest leg, in metres; further aggregates."""
    part = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    ring = part.orderBy(seq)
    full = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(full))
    legs = stops.withColumn("leg", geo.haversine(F.col("lat"), F.col("lon"), nxt("lat"), nxt("lon")))
    grouped = legs.groupBy(key) if key else legs.groupBy()
    return grouped.agg(F.round(F.sum("leg"), 3).alias("total"), F.round(F.max("leg"), 3).alias("longest"), *(also or []))


def merge(stats: DataFrame, min_points: int) -> DataFrame:
    """One row of statistics out of one per fence: sums (the longest leg too), the score anew."""
    out = stats.agg(F.sum("clusters").alias("clusters"), F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.round(F.sum("distance"), 3).alias("distance"), F.round(F.sum("longest"), 3).alias("longest"), F.max("best").alias("best"))
    return out.withColumn("score", F.col("clusters") * min_points + F.col("total") - F.col("covered"))


def bbox(points: DataFrame) -> DataFrame:
    """(min_lon, min_lat, max_lon, max_lat), six decimals; zeros without points."""
    at = lambda f, c, n: F.coalesce(F.round(f(c), 6), F.lit(0.0)).alias(n)
    return points.agg(at(F.min, "lon", "min_lon"), at(F.min, "lat", "min_lat"), at(F.max, "lon", "max_lon"), at(F.max, "lat", "max_lat"))


def centroid(points: DataFrame, key: str | None = None) -> DataFrame:
    """Mean of the unit vectors as latitude and longitude."""
    p, q = F.radians("lat"), F.radians("lon")
    grouped = points.groupBy(key) if key else points.groupBy()
    m = grouped.agg(F.avg(F.cos(p) * F.cos(q)).alias("x"), F.avg(F.cos(p) * F.sin(q)).alias("y"), F.avg(F.sin(p)).alias("z"))
    lat, lon = F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))), F.degrees(F.atan2("y", "x"))
    return m.select(*([key] if key else []), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def ecef_center(points: DataFrame) -> DataFrame:
    """Sum of the earth-centred vectors, projected radially."""
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"))
    s = points.agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(z).alias("z"))
    return s.select(F.round(F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))), 6).alias("lat"), F.round(F.degrees(F.atan2("y", "x")), 6).alias("lon"))


def area(edges: DataFrame) -> DataFrame:
    """(fid, area): square metres of each fence, the outlines of its parts less their holes."""
    edges = with_part(edges)
    ring = Window.partitionBy("fid", "part", "ring").orderBy("seq")
    full = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("ex1").over(ring), F.last("ex1").over(full))
    terms = edges.withColumn("term", geo.ring_area_term(before, F.col("ex2"), F.col("ey1")))
    rings = terms.groupBy("fid", "part", "ring").agg(F.abs(F.sum("term")).alias("a"))
    return rings.groupBy("fid").agg(F.round(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))), 0).alias("area"))
