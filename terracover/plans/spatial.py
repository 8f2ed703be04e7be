"""Queries of spatial joins, statistics, covering, tiling, routing, formats and scalar functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from terracover import engine
from terracover.functions import geo, geohash, s2
from terracover.operators import bootstrap, client, cover, formats, plugins, polygons, routing, stats
from terracover.operators.grouping import dealt, settled
from terracover.operators.joins import edge_distances, in_any_fence, nearest_between, pip_join, radius_join
from terracover.plans import s2sql
from terracover.plans.registry import Views, haversine, inside, query

RADIUS, MIN_POINTS = 70.0, 3
NEAR = f"near AS (SELECT p.id, c.cid FROM spawnpoint p JOIN cluster c ON p.lat BETWEEN c.lat - 0.001 AND c.lat + 0.001 AND {haversine('p', 'c')} <= 70)"
COUNTS = NEAR + ", cov AS (SELECT id, cid, count(*) OVER (PARTITION BY id) AS covers FROM near), cnt AS (SELECT c.cid, count(v.id) AS n_all, count(CASE WHEN v.covers = 1 THEN 1 END) AS n_unique FROM cluster c LEFT JOIN cov v ON c.cid = v.cid GROUP BY c.cid)"
RING = "leg AS (SELECT fid, seq, lat, lon, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x FROM route_point WINDOW w AS (PARTITION BY fid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
LEG = "(2*6371008.8*asin(least(1.0, sqrt(pow(sin(radians(y-lat)/2),2)+cos(radians(lat))*cos(radians(y))*pow(sin(radians(x-lon)/2),2)))))"


def over(cte: str, sql: str) -> str:
    return f"SELECT * FROM (WITH {cte} {sql})"


def _pairs(v: Views):
    return radius_join(v.spawnpoint, v.cluster, RADIUS, ["id"], ["cid"])


def _counts(v: Views):
    return stats.cluster_counts(_pairs(v), v.cluster)


@query("spawnpoint cluster", over(NEAR, "SELECT id, cid FROM near"))
def q_radius_join(v: Views):
    return _pairs(v).select("id", "cid")


@query("spawnpoint edge", inside("spawnpoint", "p.id"))
def q_pip_join(v: Views):
    return pip_join(v.spawnpoint, v.edge, ["id"])


@query("spawnpoint edge", f"SELECT DISTINCT id FROM ({inside('spawnpoint')})")
def q_pip(v: Views):
    return in_any_fence(v.spawnpoint, v.edge).select("id")


@query("spawnpoint cluster", over(NEAR, "SELECT DISTINCT id FROM near"))
def q_first_match_join(v: Views):
    return v.spawnpoint.select("id").join(_pairs(v).select("id").distinct(), "id", "left_semi")


@query("spawnpoint cluster", over(NEAR, "SELECT id, count(*) AS covers FROM near GROUP BY id"))
def q_self_cover_count(v: Views):
    return _pairs(v).groupBy("id").agg(F.count("*").alias("covers"))


@query("route_point", f"SELECT key, next_key, metres FROM (SELECT a.fid AS key, b.fid AS next_key, round(min({haversine('a', 'b')}), 3) AS metres FROM route_point a JOIN route_point b ON b.fid = a.fid + 1 GROUP BY a.fid, b.fid)")
def q_nearest_pair_join(v: Views):
    stops = settled(v.route_point)
    a = stops.select(F.col("fid").alias("key"), (F.col("fid") + 1).alias("next_key"), F.col("seq").alias("a_seq"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = stops.select(F.col("fid").alias("next_key"), F.col("seq").alias("b_seq"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return nearest_between(a, b).select("key", "next_key", "metres")


@query("spawnpoint cluster", over(COUNTS, "SELECT cid, n_all, n_unique FROM cnt"))
def q_agg_cluster_counts(v: Views):
    return _counts(v)


@query("spawnpoint cluster", over(NEAR, "SELECT cid, count(*) AS n_all, count(DISTINCT concat(p.lat, ',', p.lon)) AS n_distinct FROM near JOIN spawnpoint p USING (id) GROUP BY cid"))
def q_agg_unique_dedupe(v: Views):
    places = v.spawnpoint.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    return radius_join(places, v.cluster, RADIUS, ["n"], ["cid"]).groupBy("cid").agg(F.sum("n").alias("n_all"), F.count("*").alias("n_distinct"))


@query("spawnpoint cluster", over(COUNTS, "SELECT n_all AS size, count(*) AS clusters FROM cnt GROUP BY n_all"))
def q_agg_histograms(v: Views):
    return stats.histogram(_counts(v), "n_all")


@query("spawnpoint cluster", over(COUNTS, "SELECT cid, n_all, n_unique FROM cnt WHERE n_all = (SELECT max(n_all) FROM cnt)"))
def q_agg_best(v: Views):
    return stats.best(settled(_counts(v)))


@query("spawnpoint cluster", over(COUNTS + ", below AS (SELECT n_all FROM (SELECT n_all, max(n_all) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cnt) WHERE n_all < before)", "SELECT coalesce(min(n_all), 0) AS worst, (SELECT count(*) FROM below b WHERE b.n_all = (SELECT min(n_all) FROM below)) AS clusters FROM below"))
def q_agg_worst(v: Views):
    return stats.worst(_counts(v), "cid")


@query("spawnpoint cluster", over(NEAR, "SELECT count(DISTINCT id) AS covered FROM near"))
def q_agg_points_covered(v: Views):
    return _pairs(v).agg(F.countDistinct("id").alias("covered"))


@query("spawnpoint cluster", over(NEAR, "SELECT c.clusters, t.total, n.covered, c.clusters * 3 + t.total - n.covered AS score FROM (SELECT count(*) AS clusters FROM cluster) c, (SELECT count(*) AS total FROM spawnpoint) t, (SELECT count(DISTINCT id) AS covered FROM near) n"))
def q_agg_score(v: Views):
    return stats.coverage(_pairs(v), v.cluster, v.spawnpoint, MIN_POINTS)


@query("route_point", over(RING, f"SELECT fid, round(sum({LEG}), 3) AS total, round(max({LEG}), 3) AS longest FROM leg GROUP BY fid"))
def q_agg_tour_distance(v: Views):
    return stats.tour(v.route_point, "fid")


@query("route_point", over(RING, f"SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS covered, round(sum(total), 3) AS distance, round(sum(longest), 3) AS longest, max(n) AS best, count(*) * 3 AS score FROM (SELECT fid, count(*) AS n, round(sum({LEG}), 3) AS total, round(max({LEG}), 3) AS longest FROM leg GROUP BY fid)"))
def q_agg_stats_merge(v: Views):
    n = v.route_point.groupBy("fid").agg(F.count("*").alias("n"))
    per = stats.tour(v.route_point, "fid").join(n, "fid").select(F.lit(1).alias("clusters"), F.col("n").alias("total"), F.col("n").alias("covered"), F.col("total").alias("distance"), "longest", F.col("n").alias("best"))
    return stats.merge(per, MIN_POINTS)


@query("spawnpoint", "SELECT round(min(lon), 6) AS min_lon, round(min(lat), 6) AS min_lat, round(max(lon), 6) AS max_lon, round(max(lat), 6) AS max_lat FROM spawnpoint")
def q_agg_bbox(v: Views):
    return stats.bbox(v.spawnpoint)


@query("route_point", "SELECT fid, round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM (SELECT fid, avg(cos(radians(lat))*cos(radians(lon))) AS x, avg(cos(radians(lat))*sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM route_point GROUP BY fid)")
def q_agg_centroid(v: Views):
    return stats.centroid(v.route_point, "fid")


_N = "(40680631590769.0/sqrt(40680631590769.0*cos(radians(lat))*cos(radians(lat))+40408299984659.15*sin(radians(lat))*sin(radians(lat))))"


@query("gym", f"SELECT round(degrees(atan2(z, sqrt(x*x+y*y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM (SELECT sum({_N}*cos(radians(lat))*cos(radians(lon))) AS x, sum({_N}*cos(radians(lat))*sin(radians(lon))) AS y, sum({_N}*(40408299984659.15/40680631590769.0)*sin(radians(lat))) AS z FROM gym)")
def q_agg_ecef_center(v: Views):
    return stats.ecef_center(v.gym)


@query("fence", "SELECT fid, round(abs(radians(x1-x0)*(sin(radians(y1))-sin(radians(y0)))*6378137.0*6378137.0) - CASE WHEN fid%2=1 THEN abs(radians((x1-0.0026)-(x0+0.0026))*(sin(radians(y1-0.0026))-sin(radians(y0+0.0026)))*6378137.0*6378137.0) ELSE 0 END, 0) AS area FROM fence")
def q_agg_area(v: Views):
    return stats.area(v.edge)


@query("spawnpoint", f"SELECT {s2sql.signed('c')} AS cell, count(*) AS n FROM (SELECT {s2sql.cell(15)} AS c FROM ({s2sql.ij('SELECT * FROM spawnpoint')})) GROUP BY c")
def q_agg_s2_cell_count(v: Views):
    return cover.s2_counts(v.spawnpoint, 15)


@query("stop_in_fence", "SELECT fid, count(*) AS n, string_agg(printf('%.6f,%.6f', lat, lon), ' ' ORDER BY pk) AS points FROM stop_in_fence GROUP BY fid")
def q_agg_merge_points(v: Views):
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pk", F.format_string("%.6f,%.6f", "lat", "lon").alias("t")))), lambda x: x["t"]), " ")
    return v.stop_in_fence.groupBy("fid").agg(F.count("*").alias("n"), text.alias("points"))


@query()
def q_agg_combine_bootstrap(v: Views):
    tiles = bootstrap.by_radius(v.edge, RADIUS).join(v.fence.select("fid", "parent"), "fid")
    return tiles.groupBy("parent").agg(F.count("*").alias("n"), F.size(F.collect_set("fid")).alias("fences"))


# --- covering -------------------------------------------------------------------------------------


@query("spawnpoint", "SELECT CAST(floor(lon / CAST(0.0008 AS DOUBLE)) AS BIGINT) AS bx, CAST(floor(lat / CAST(0.0008 AS DOUBLE)) AS BIGINT) AS by, count(*) AS n FROM spawnpoint GROUP BY 1, 2 HAVING count(*) >= 3")
def q_clu_fastest_buckets(v: Views):
    return cover.bucket_cover(v.spawnpoint, 0.0008, MIN_POINTS)


def _inside(v: Views):
    return pip_join(v.spawnpoint, v.edge, ["id", "lat", "lon"])


@query()
def q_clu_fastest(v: Views):
    return cover.fastest_cover(_inside(v), RADIUS, MIN_POINTS)


@query()
def q_clu_fast(v: Views):
    return cover.greedy_cover(_inside(v), RADIUS, MIN_POINTS, "fast")


@query()
def q_clu_split(v: Views):
    return cover.greedy_cover(_inside(v), RADIUS, MIN_POINTS, "fast", split=s2.cell(F.col("lat"), F.col("lon"), 14))


@query()
def q_clu_max_clusters(v: Views):
    return cover.greedy_cover(_inside(v), RADIUS, MIN_POINTS, "fast", max_clusters=10)


@query()
def q_clu_missing(v: Views):
    return cover.greedy_cover(_inside(v), RADIUS, 1, "fast")


@query()
def q_clu_center(v: Views):
    inside = _inside(v)
    found = cover.fastest_cover(inside, RADIUS, MIN_POINTS).select("fid", F.col("cid").alias("seq"), "lat", "lon")
    return engine.centred(found, inside, RADIUS)


@query("spawnpoint cluster", over(COUNTS, "SELECT id, min(c.cid) AS cid FROM (SELECT v.id, max(n_all) AS top FROM cov v JOIN cnt USING (cid) GROUP BY v.id) m JOIN cov c USING (id) JOIN cnt k ON k.cid = c.cid AND k.n_all = m.top GROUP BY id"))
def q_clu_first_claims(v: Views):
    return cover.nearby_claims(v.spawnpoint, v.cluster, RADIUS)


@query("spawnpoint edge", s2sql.block_counts(f"SELECT DISTINCT id, lat, lon FROM ({inside('spawnpoint')})", 17, 3, MIN_POINTS))
def q_clu_s2(v: Views):
    return cover.s2_block_cover(in_any_fence(v.spawnpoint, v.edge), bootstrap.by_s2(v.edge, 17, 3), 17, 3, MIN_POINTS)


@query("spawnpoint cluster", over(NEAR, "SELECT cid, count(*) AS n FROM near GROUP BY cid HAVING count(*) >= 3"))
def q_cand_assoc(v: Views):
    return _pairs(v).groupBy("cid").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_POINTS)


@query("gym", "SELECT id, round(greatest(degrees(70/6371000.0), degrees(70/6371000.0)/cos(radians(lat))), 9) AS deg FROM gym")
def q_cand_meters_to_degrees(v: Views):
    return v.gym.select("id", F.round(geo.metres_to_degrees(F.col("lat"), F.lit(RADIUS)), 9).alias("deg"))


@query("spawnpoint cluster", over(COUNTS, "SELECT cid FROM cnt WHERE n_unique >= 1"))
def q_greedy_unique_prune(v: Views):
    return _counts(v).where("n_unique >= 1").select("cid")


@query("spawnpoint cluster", over(NEAR, "SELECT id FROM spawnpoint WHERE id NOT IN (SELECT id FROM near)"))
def q_greedy_missing(v: Views):
    return v.spawnpoint.select("id").join(_pairs(v).select("id").distinct(), "id", "left_anti")


def _on_plane(v: Views, out):
    """out(plane, lat, lon) of every stop on its fence's tangent plane."""
    import pandas as pd

    def run(key, g):
        g = g.sort_values("seq")
        a, b = out(cover.Plane(g["lat"].to_numpy(float), g["lon"].to_numpy(float), RADIUS), g["lat"].to_numpy(float), g["lon"].to_numpy(float))
        return pd.DataFrame({"fid": key[0], "seq": g["seq"].to_numpy(), "a": a, "b": b})

    return dealt(v.route_point.select("fid", "seq", "lat", "lon"), "fid").groupBy("fid").applyInPandas(run, "fid long, seq long, a double, b double")


_FLAT = "(40408299984659.15/40680631590769.0)"
_PLANE = f"""p AS (SELECT fid, seq, {_N}*cos(radians(lat))*cos(radians(lon)) AS x, {_N}*cos(radians(lat))*sin(radians(lon)) AS y, {_N}*{_FLAT}*sin(radians(lat)) AS z FROM route_point),
m AS (SELECT fid, degrees(atan2(sum(z), {_FLAT}*sqrt(sum(x)*sum(x)+sum(y)*sum(y)))) AS lat, degrees(atan2(sum(y), sum(x))) AS lon FROM p GROUP BY fid),
c AS (SELECT fid, cos(radians(lat)) AS cp, sin(radians(lat)) AS sp, cos(radians(lon)) AS cq, sin(radians(lon)) AS sq, {_N} AS n FROM m),
o AS (SELECT *, n*(cp*cp + {_FLAT}*sp*sp) AS height, n*sp*cp*({_FLAT} - 1) AS north FROM c),
xy AS (SELECT fid, seq, (y*cq - x*sq)*s/u AS e, ((z*cp - x*sp*cq - y*sp*sq)*s - north)/u AS n FROM (SELECT *, height/(x*cp*cq + y*cp*sq + z*sp) AS s, 0.5*6356752.314245179*sin(2*70/6356752.314245179) AS u FROM p JOIN o USING (fid)))"""


@query("route_point", over(_PLANE, "SELECT fid, seq, round(e, 6) AS a, round(n, 6) AS b FROM xy"))
def q_proj_plane(v: Views):
    """Stops on the plane: east and north in radii."""
    return _on_plane(v, lambda plane, lat, lon: plane.forward(lat, lon).T).select("fid", "seq", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("route_point", "SELECT fid, seq, round(lat, 6) AS a, round(lon, 6) AS b FROM route_point")
def q_proj_reverse(v: Views):
    """Stops taken to the plane and back."""
    return _on_plane(v, lambda plane, lat, lon: plane.reverse(plane.forward(lat, lon))).select("fid", "seq", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


# --- tiling ---------------------------------------------------------------------------------------


@query()
def q_boot_radius(v: Views):
    return bootstrap.tagged(bootstrap.by_radius(v.edge, RADIUS), v.fence, "circle_pokemon")


@query()
def q_boot_s2(v: Views):
    return bootstrap.by_s2(v.edge, 17, 3)


_FOOT = "greatest(0.0, least(1.0, ((g.lon-e.ex1)*(e.ex2-e.ex1)+(g.lat-e.ey1)*(e.ey2-e.ey1))/((e.ex2-e.ex1)*(e.ex2-e.ex1)+(e.ey2-e.ey1)*(e.ey2-e.ey1))))"
_FEET = f"SELECT id, fid, lat, lon, ey1 + t*(ey2-ey1) AS fy, ex1 + t*(ex2-ex1) AS fx FROM (SELECT g.id, g.lat, g.lon, e.fid, e.ex1, e.ey1, e.ex2, e.ey2, {_FOOT} AS t FROM gym g CROSS JOIN edge e)"


@query("gym edge", f"SELECT id, fid, round(min(m), 3) AS metres FROM (SELECT id, fid, 2*6371008.8*asin(least(1.0, sqrt(pow(sin(radians(fy-lat)/2),2)+cos(radians(lat))*cos(radians(fy))*pow(sin(radians(fx-lon)/2),2)))) AS m FROM ({_FEET})) WHERE m <= 300 GROUP BY id, fid")
def q_seg_distance(v: Views):
    """Distances to the sides of every fence within 300 m of a point."""
    return edge_distances(v.gym, v.edge, ["id"], 300.0).select("id", "fid", F.round("metres", 3).alias("metres"))


# --- routing --------------------------------------------------------------------------------------


def _stops(v: Views):
    return v.stop_in_fence.select("fid", F.col("pk").alias("seq"), "lat", "lon")


@query("stop_in_fence", "SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY lat DESC, lon DESC, pk) - 1 AS seq, lat, lon FROM stop_in_fence")
def q_sort_latlon(v: Views):
    return routing.by_lat_lon(_stops(v))


_HASH = " || ".join("substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + " + " + ".join(f"((CAST({'x' if (5 * k + j) % 2 == 0 else 'y'} AS BIGINT) >> {29 - (5 * k + j) // 2}) & 1) * {16 >> j}" for j in range(5)) + " AS BIGINT), 1)" for k in range(12))
_HASHED = f"SELECT *, {_HASH} AS g FROM (SELECT *, floor((lon + 180) / 360 * 1073741824.0) AS x, floor((lat + 90) / 180 * 1073741824.0) AS y FROM stop_in_fence)"


@query("stop_in_fence", f"SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY g, pk) - 1 AS seq, lat, lon FROM ({_HASHED})")
def q_sort_geohash(v: Views):
    return routing.by_geohash(_stops(v))


@query("stop_in_fence", f"SELECT pk, g AS geohash FROM ({_HASHED})")
def q_fn_geohash(v: Views):
    return v.stop_in_fence.select("pk", geohash.encode(F.col("lat"), F.col("lon"), 12).alias("geohash"))


@query("spawnpoint cluster", over(COUNTS, "SELECT cid, row_number() OVER (ORDER BY n_all DESC, cid) - 1 AS seq FROM cnt"))
def q_sort_point_count(v: Views):
    stops = _counts(v).join(v.cluster, "cid").select(F.lit(0).alias("fid"), F.col("cid").alias("seq"), "cid", "lat", "lon", "n_all")
    return routing.by_point_count(stops).select("cid", "seq")


@query("stop_in_fence", f"SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY c, pk) - 1 AS seq, lat, lon FROM (SELECT fid, pk, lat, lon, {s2sql.cell(30)} AS c FROM ({s2sql.ij('SELECT * FROM stop_in_fence')}))")
def q_sort_s2(v: Views):
    return routing.by_s2(_stops(v))


@query()
def q_sort_random(v: Views):
    return routing.by_random(_stops(v))


@query("route_point", "SELECT fid, seq, lat, lon FROM route_point")
def q_sort_unset(v: Views):
    return routing.by_unset(v.route_point).select("fid", "seq", "lat", "lon")


@query()
def q_sort_tsp(v: Views):
    return routing.by_tour(_stops(v))


@query()
def q_route_join(v: Views):
    return routing.by_tour(_stops(v), s2.cell(F.col("lat"), F.col("lon"), 15))


@query("route_point", f"SELECT a.fid, a.seq AS a, b.seq AS b, CAST(round({haversine('a', 'b')} * (6372800.0/6371008.8)) AS BIGINT) AS metres FROM route_point a JOIN route_point b ON a.fid = b.fid")
def q_dist_matrix(v: Views):
    return routing.distances(v.route_point)


@query("route_point", "SELECT r.fid, ((r.seq - k) % n + n) % n AS seq, lat, lon FROM route_point r JOIN (SELECT fid, max(CASE WHEN pk % 7 = 0 THEN seq END) AS k0, coalesce(max(CASE WHEN pk % 7 = 0 THEN seq END), 0) AS k, count(*) AS n FROM route_point GROUP BY fid) m ON m.fid = r.fid")
def q_rotate_to_best(v: Views):
    return routing.rotated(v.route_point.select("fid", "seq", "lat", "lon"), v.route_point.where("pk % 7 = 0")).select("fid", "seq", "lat", "lon")


# --- formats --------------------------------------------------------------------------------------


@query("area", "SELECT id, CASE WHEN id%5=0 THEN '' ELSE '40.'||(id+10)||'0000,-74.250000|40.500000,-74.500000|40.750000,-74.750000|40.'||(id+10)||'0000,-74.250000' END AS points FROM area")
def q_parse_text(v: Views):
    return v.area.select("id", formats.to_text(formats.parse_text(F.col("geofence")), ",", "|").alias("points"))


@query("fence", "SELECT fid, CAST(5 AS INT) AS n FROM fence")
def q_ensure_closed(v: Views):
    return formats.rings(v.edge).where("ring = 0").select("fid", F.size("points").alias("n"))


@query("fence", "SELECT fid, CAST(4 AS INT) AS n FROM fence")
def q_ensure_closed_geojson(v: Views):
    """Rings whose ends share a coordinate stay open."""
    open_ = formats.rings(v.edge).where("ring = 0").select("fid", F.slice("points", 1, 4).alias("p"))
    return open_.select("fid", F.size(formats.closed_geojson(F.col("p"))).alias("n"))


@query("instance", "SELECT id, CASE WHEN type IN ('auto_quest','pokemon_iv') THEN 'MultiPolygon' WHEN type = 'leveling' THEN 'Point' ELSE 'MultiPoint' END AS geo_type FROM instance")
def q_geometry_from_enum(v: Views):
    from terracover.functions.props import AREA_MODES

    return v.instance.select("id", F.when(F.col("type").isin(*AREA_MODES), "MultiPolygon").when(F.col("type") == "leveling", "Point").otherwise("MultiPoint").alias("geo_type"))


@query("route_point", "SELECT fid, min(seq) AS seq FROM (SELECT fid, seq, lat, lon FROM route_point UNION ALL SELECT fid, seq + 1000, lat, lon FROM route_point) GROUP BY fid, lat, lon")
def q_multipoint_dedupe(v: Views):
    both = v.route_point.select("fid", "seq", "lat", "lon").unionByName(v.route_point.select("fid", (F.col("seq") + 1000).alias("seq"), "lat", "lon"))
    return formats.deduplicated(both, "fid").select("fid", "seq")


@query("fence", "SELECT fid, 0 AS ring, 5 AS n FROM fence UNION ALL SELECT fid, 1, 5 FROM fence WHERE fid%2=1")
def q_explode_multi(v: Views):
    parts = formats.rings(v.edge).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("rs"))
    return parts.select("fid", F.posexplode("rs").alias("ring", "r")).select("fid", "ring", F.size("r.points").alias("n"))


@query("fence", "SELECT fid, CAST(CASE WHEN fid%2=1 THEN 10 ELSE 5 END AS INT) AS n FROM fence")
def q_flatten_coords(v: Views):
    parts = formats.rings(v.edge).groupBy("fid").agg(F.collect_list("points").alias("rs"))
    return parts.select("fid", F.size(F.flatten("rs")).alias("n"))


@query()
def q_simplify(v: Views):
    return formats.rings(v.edge).select("fid", "ring", F.size(formats.simplified(F.col("points"))).alias("n"))


@query("gym", "SELECT id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM gym")
def q_trim_precision(v: Views):
    p = F.element_at(formats.trim_precision(F.array(F.struct("lat", "lon")), 4), 1)
    return v.gym.select("id", p["lat"].alias("lat"), p["lon"].alias("lon"))


@query("fence", "SELECT fid, printf('%.6f,%.6f', y0, x0) || chr(10) || printf('%.6f,%.6f', y0, x1) || chr(10) || printf('%.6f,%.6f', y1, x1) || chr(10) || printf('%.6f,%.6f', y1, x0) || chr(10) || printf('%.6f,%.6f', y0, x0) AS t FROM fence")
def q_to_text(v: Views):
    return formats.rings(v.edge).where("ring = 0").select("fid", formats.to_text(F.col("points")).alias("t"))


_BOX = "printf('[[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f]]', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)"


@query("ring", "SELECT fid, 'ST_CONTAINS(ST_GeomFromGeoJSON(''{\"type\":\"Polygon\",\"coordinates\":[' || string_agg(" + _BOX + ", ',' ORDER BY ring) || ']}'', 2, 0), POINT(lon, lat))' AS sql FROM ring GROUP BY fid")
def q_gen_sql_st_contains(v: Views):
    """Every fence, holes as further rings."""
    return formats.sql_contains(formats.rings(v.edge))


@query("fence geofence", "SELECT row_number() OVER (ORDER BY f.name) AS id, f.name, p.name AS \"group\", fid%2=0 AS single FROM fence f JOIN geofence p ON f.parent = p.id")
def q_to_poracle(v: Views):
    groups = v.geofence.select(F.col("id").alias("parent"), F.col("name").alias("group"))
    out = formats.poracle(v.fence, formats.rings(v.edge), groups)
    return out.select("id", "name", "group", F.col("path").isNotNull().alias("single"))


@query("route", "SELECT concat_ws('__', CAST(id AS VARCHAR), mode, 'ROUTE') AS fid, name, points FROM route")
def q_route_to_feature(v: Views):
    return v.route.select(F.concat_ws("__", F.col("id").cast("string"), "mode", F.lit("ROUTE")).alias("fid"), "name", "points")


@query("area", "SELECT id, 'geofence' AS kind FROM area WHERE geofence <> '' UNION ALL SELECT id, 'fort' FROM area WHERE fort_mode_route <> '' UNION ALL SELECT id, 'pokemon' FROM area WHERE pokemon_mode_route <> '' UNION ALL SELECT id, 'quest' FROM area WHERE quest_mode_route <> ''")
def q_area_normalise(v: Views):
    rows = v.area.selectExpr("id", "stack(4, 'geofence', geofence, 'fort', fort_mode_route, 'pokemon', pokemon_mode_route, 'quest', quest_mode_route) as (kind, t)")
    return rows.where("t is not null and t <> ''").select("id", "kind")


@query()
def q_to_geojson(v: Views):
    rings = formats.rings(v.edge).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("ring", F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("p")))).alias("rs"))
    return rings.join(v.fence, "fid").select("fid", formats.collection("Polygon", F.col("fid"), F.col("name"), F.transform("rs", lambda r: r["p"])).alias("feature"))


# --- scalar functions -----------------------------------------------------------------------------


@query("gym station", f"SELECT g.id AS a, s.id AS b, round({haversine('g', 's')}, 3) AS metres FROM gym g JOIN station s ON substr(g.id, 2) = substr(s.id, 2)")
def q_fn_haversine(v: Views):
    s = v.station.select(F.col("id").alias("b"), F.col("lat").alias("y"), F.col("lon").alias("x"), F.substr("id", F.lit(2)).alias("k"))
    g = v.gym.select(F.col("id").alias("a"), "lat", "lon", F.substr("id", F.lit(2)).alias("k"))
    return g.join(s, "k").select("a", "b", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")), 3).alias("metres"))


@query("gym", "SELECT id, round(degrees(q), 6) AS lat, round(lon + degrees(atan2(sin(radians(30))*sin(d)*cos(radians(lat)), cos(d)-sin(radians(lat))*sin(q))), 6) AS lon FROM (SELECT *, 500/6371008.8 AS d, asin(sin(radians(lat))*cos(500/6371008.8)+cos(radians(lat))*sin(500/6371008.8)*cos(radians(30))) AS q FROM gym)")
def q_fn_destination(v: Views):
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(500.0))
    return v.gym.select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("gym", f"SELECT id, round({_N}*cos(radians(lat))*cos(radians(lon)), 2) AS x, round({_N}*cos(radians(lat))*sin(radians(lon)), 2) AS y, round({_N}*(40408299984659.15/40680631590769.0)*sin(radians(lat)), 2) AS z FROM gym")
def q_fn_ecef(v: Views):
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"))
    return v.gym.select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(z, 2).alias("z"))


@query()
def q_s2_cells(v: Views):
    leaf = s2.cell(F.col("lat"), F.col("lon"), 30)
    rows = v.gym.select("id", leaf.alias("leaf"))
    return rows.select("id", s2.unsigned(F.col("leaf")).alias("leaf"), s2.unsigned(s2.parent_of(F.col("leaf"), 15)).alias("cell"), s2.center(s2.parent_of(F.col("leaf"), 15)).alias("center"), s2.corners(s2.parent_of(F.col("leaf"), 15)).alias("corners"))


@query("gym", f"SELECT id, CAST({s2sql.cell(30)} AS VARCHAR) AS leaf, CAST({s2sql.cell(15)} AS VARCHAR) AS cell FROM ({s2sql.ij('SELECT * FROM gym')})")
def q_s2_ids(v: Views):
    """Leaf cells and their ancestors."""
    rows = v.gym.select("id", s2.cell(F.col("lat"), F.col("lon"), 30).alias("leaf"))
    return rows.select("id", s2.unsigned(F.col("leaf")).alias("leaf"), s2.unsigned(s2.parent_of(F.col("leaf"), 15)).alias("cell"))


_BOUNDS = "SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fence"
_OUTLINES = f"SELECT face, ci, cj, min(lat) AS low, max(lat) AS high, min(lon) AS west, max(lon) AS east FROM ({s2sql.corners(s2sql.domain(f'SELECT y0 AS lat, x0 AS lon FROM ({_BOUNDS}) UNION ALL SELECT y1, x1 FROM ({_BOUNDS})', 15, 3), 15, 'face, ci, cj')}) GROUP BY face, ci, cj"


@query("fence", f"SELECT CAST({s2sql.cell(15, '(ci * 32768)', '(cj * 32768)')} AS VARCHAR) AS cell FROM ({_OUTLINES}) o JOIN ({_BOUNDS}) b ON high >= y0 AND low <= y1 AND east >= x0 AND west <= x1")
def q_s2_cover_rect(v: Views):
    """The cells that meet the bounds of all fences."""
    box = v.fence.agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))
    cells = box.select(F.explode(s2.cells_in_box(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"), 15)).alias("cell"))
    return cells.select(s2.unsigned(F.col("cell")).alias("cell"))


@query()
def q_s2_circle_coverage(v: Views):
    gym = dealt(v.gym.select("id", "lat", "lon"), "id")
    return gym.select("id", F.explode(s2.cells_within(F.col("lat"), F.col("lon"), 200.0, 17)).alias("cell"))


@query("gym", over(f"g AS (SELECT id, enabled, {s2sql.cell(15)} AS c FROM ({s2sql.ij('SELECT * FROM gym')}))", f"SELECT {s2sql.signed('c')} AS cell, id FROM g WHERE c IN (SELECT c FROM g WHERE enabled = 1)"))
def q_flt_s2_ids(v: Views):
    wanted = v.gym.where("enabled = 1").select(s2.cell(F.col("lat"), F.col("lon"), 15).alias("cell"))
    return v.gym.select("id", s2.cell(F.col("lat"), F.col("lon"), 15).alias("cell")).join(wanted, "cell", "left_semi")


@query("route_point", "SELECT fid, seq, (seq + 2) % n AS turned FROM (SELECT fid, seq - 1 AS seq, count(*) OVER (PARTITION BY fid) AS n FROM route_point)")
def q_fn_arrays(v: Views):
    """rotate_left by the window's size, as array functions."""
    lists = v.route_point.groupBy("fid").agg(F.array_sort(F.collect_list(F.col("seq") - 1)).alias("a"))
    n = F.size("a")
    turned = F.concat(F.slice("a", F.pmod(F.lit(2), n) + 1, n), F.slice("a", F.lit(1), F.pmod(F.lit(2), n)))
    return lists.select("fid", F.posexplode(turned).alias("pos", "turned")).select("fid", F.col("pos").cast("long").alias("seq"), F.col("turned").cast("long").alias("turned"))


@query("spawnpoint cluster", over(COUNTS, "SELECT size, CAST(sum(clusters) AS BIGINT) AS clusters FROM (SELECT n_all AS size, count(*) AS clusters FROM cnt GROUP BY n_all UNION ALL SELECT n_unique, count(*) FROM cnt GROUP BY n_unique) GROUP BY size"))
def q_fn_maps(v: Views):
    """Two histograms as maps, merged additively."""
    counts = settled(_counts(v))
    as_map = lambda c: stats.histogram(counts, c).agg(F.map_from_entries(F.collect_list(F.struct("size", "clusters"))).alias("m"))
    both = as_map("n_all").crossJoin(as_map("n_unique").withColumnRenamed("m", "k"))
    merged = F.map_zip_with("m", "k", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return both.select(F.explode(merged).alias("size", "clusters"))


# --- edits ----------------------------------------------------------------------------------------


@query("gym edge", f"SELECT id FROM gym WHERE id NOT IN (SELECT id FROM ({inside('gym')}))")
def q_ui_filter_points(v: Views):
    return client.filter_points(v.gym, v.edge, keep_inside=False).select("id")


@query("fence", "SELECT a.fid AS a, b.fid AS b FROM fence a JOIN fence b ON a.x0 + 0.004 < b.x1 AND b.x0 < a.x1 + 0.004 AND a.y0 + 0.004 < b.y1 AND b.y0 < a.y1 + 0.004")
def q_ui_filter_polys(v: Views):
    """Outlines moved north-east, and those that they share area with."""
    outer = v.edge.where("ring = 0")
    moved = outer.select("fid", "ring", "seq", *(F.expr(f"{c} + cast(0.004 as double)").alias(c) for c in ("ex1", "ey1", "ex2", "ey2")))
    return polygons.intersecting(moved, outer)


@query("edge", "SELECT fid, ring, seq, ex1, ey1, ex2, ey2 FROM edge WHERE ring > 0")
def q_ui_cutouts(v: Views):
    return client.cutouts(v.edge)


@query("route_point", "SELECT fid, count(*) * 2 - 1 AS n, round(sum(lat), 4) AS total FROM route_point GROUP BY fid HAVING count(*) = 1 UNION ALL SELECT fid, count(*) * 2 - 1, round(sum(lat) * 2 - (first(lat ORDER BY seq) + last(lat ORDER BY seq)) / 2, 4) FROM route_point GROUP BY fid HAVING count(*) > 1")
def q_ui_split_line(v: Views):
    return client.split_lines(v.route_point, "fid").groupBy("fid").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 4).alias("total"))


@query("edge", "SELECT concat(f.name, '__', CAST(ring AS VARCHAR)) AS name, count(*) AS edges FROM edge e JOIN fence f USING (fid) GROUP BY f.name, ring")
def q_ui_split_multipolygon(v: Views):
    return v.edge.join(v.fence.select("fid", "name"), "fid").groupBy(F.concat("name", F.lit("__"), F.col("ring").cast("string")).alias("name")).agg(F.count("*").alias("edges"))


@query("route_point", "SELECT fid, seq, coalesce(lead(seq) OVER w, first_value(seq) OVER w) AS forward, coalesce(lag(seq) OVER w, last_value(seq) OVER w) AS backward FROM route_point WINDOW w AS (PARTITION BY fid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def q_ui_route_links(v: Views):
    return client.links(v.route_point, "fid")


@query("route_point", "SELECT fid, seq, coalesce(lead(seq) OVER w, first_value(seq) OVER w) AS next FROM route_point WINDOW w AS (PARTITION BY fid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def q_ui_mp_to_points(v: Views):
    return client.links(v.route_point, "fid").select("fid", "seq", F.col("forward").alias("next"))


@query("route_point", over(RING, f"SELECT fid, count(*) AS n, round(sum({LEG}), 3) AS total, round(max({LEG}), 3) AS longest, round(min(lat), 6) AS min_lat, round(max(lon), 6) AS max_lon FROM leg GROUP BY fid"))
def q_ui_geojson_stats(v: Views):
    box = v.route_point.groupBy("fid").agg(F.count("*").alias("n"), F.round(F.min("lat"), 6).alias("min_lat"), F.round(F.max("lon"), 6).alias("max_lon"))
    return stats.tour(v.route_point, "fid").join(box, "fid").select("fid", "n", "total", "longest", "min_lat", "max_lon")


@query("route_point", "SELECT fid, CASE WHEN d <= 500 THEN 'green' WHEN d <= 1000 THEN 'yellow' WHEN d <= 1500 THEN 'orange' ELSE 'red' END AS colour, count(*) AS legs FROM (SELECT fid, (2*6371008.8*asin(least(1.0, sqrt(pow(sin(radians(y-lat)/2),2)+cos(radians(lat))*cos(radians(y))*pow(sin(radians(x-lon)/2),2))))) AS d FROM (SELECT fid, lat, lon, lead(lat) OVER w AS y, lead(lon) OVER w AS x FROM route_point WINDOW w AS (PARTITION BY fid ORDER BY seq))) WHERE d IS NOT NULL GROUP BY 1, 2")
def q_ui_leg_colours(v: Views):
    return client.leg_colours(v.route_point, "fid")


@query()
def q_ui_batch_calc(v: Views):
    found = cover.fastest_cover(_inside(v), RADIUS, MIN_POINTS)
    tours = routing.by_tour(found.select("fid", F.col("cid").alias("seq"), "lat", "lon"))
    return stats.tour(tours, "fid").join(found.groupBy("fid").agg(F.count("*").alias("clusters")), "fid")


@query()
def q_plugin_routing(v: Views):
    plugins.register("routing", "by_longitude", lambda g, _: g.sort_values(["lon", "lat"]))
    return plugins.run(v.route_point, "routing", "by_longitude", "fid")


def flagship(v: Views):
    """Points in fences, covered greedily, toured and scored per fence: one pass over the points."""
    found = cover.greedy_cover(_inside(v), RADIUS, MIN_POINTS, "fast")
    tours = routing.by_tour(found.select("fid", F.col("cid").alias("seq"), "lat", "lon", "points", "covered"))
    sizes = [F.max("points").alias("points"), F.count("*").alias("clusters"), F.max("covered").alias("covered")]
    out = stats.tour(tours, "fid", also=sizes)
    score = F.col("clusters") * MIN_POINTS + F.col("points") - F.col("covered")
    return out.select("fid", "points", "clusters", "covered", score.alias("score"), F.col("total").alias("distance"), "longest")


@query()
def q_coverage_route(v: Views):
    return flagship(v)


