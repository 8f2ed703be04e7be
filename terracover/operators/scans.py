"""Scans of the point tables and the reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.operators.joins import in_any_fence, within_bounds

#: The service's cap on the rows of a scan, for `limit`.
LIMIT = 2_000_000


def with_tth(tth: str) -> Column:
    """All, Known or Unknown despawn times."""
    return {"all": F.col("id").isNotNull(), "known": F.col("despawn_sec").isNotNull(), "unknown": F.col("despawn_sec").isNull()}[tth]


def in_bounds(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    return F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon)


def filtered(points: DataFrame, where: Column, bounds: tuple | None = None, edges: DataFrame | None = None, key: str = "id", limit: int | None = None) -> DataFrame:
    """The scan's rows: all, within bounds, or inside fences; with a limit, the first by key of all or within bounds."""
    rows = points.where(where)
    if bounds:
        rows = rows.where(in_bounds(*bounds))
    if edges is not None:
        return in_any_fence(within_bounds(rows, edges), edges)
    return rows if limit is None else rows.orderBy(key).limit(limit)


def spawnpoints(points: DataFrame, last_seen: int, tth: str = "all", **how) -> DataFrame:
    return filtered(points, (F.col("last_seen") > last_seen) & with_tth(tth), **how).select("id", "lat", "lon", "despawn_sec")


def forts(points: DataFrame, updated: int, **how) -> DataFrame:
    """Gyms and stops: enabled, not deleted, updated later than a time."""
    return filtered(points, (F.col("updated") > updated) & (F.col("deleted") == 0) & (F.col("enabled") == 1), **how).select("id", "lat", "lon")


def stations(points: DataFrame, updated: int, now: int, **how) -> DataFrame:
    return filtered(points, (F.col("updated") > updated) & (F.col("is_inactive") == 0) & (F.col("end_time") > now), **how).select("id", "lat", "lon")


def area_references(areas: DataFrame) -> DataFrame:
    """One row per mode that an area has a text for: (id, name, mode)."""
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    modes = (("geofence", "auto_quest"), ("fort_mode_route", "circle_raid"), ("pokemon_mode_route", "circle_pokemon"), ("quest_mode_route", "circle_quest"))
    found = F.filter(F.array(*(F.when(there(c), F.lit(m)) for c, m in modes)), lambda x: x.isNotNull())
    return areas.select("id", "name", F.explode(found).alias("mode"))
