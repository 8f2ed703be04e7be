"""Queries of scans, filters, the catalog and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracover.functions import names, props
from terracover.operators import catalog, scans
from terracover.operators.joins import pip_join
from terracover.plans.registry import Views, inside, query
from terracover.sources.fixtures import NOW

SEEN = 1_704_100_000
BOUNDS = (40.01, -73.99, 40.03, -73.97)
IN_BOUNDS = "lat BETWEEN CAST(40.01 AS DOUBLE) AND CAST(40.03 AS DOUBLE) AND lon BETWEEN CAST(-73.99 AS DOUBLE) AND CAST(-73.97 AS DOUBLE)"
FORT = "updated > 20000 AND deleted = 0 AND enabled = 1"
STATION = f"updated > 20000 AND is_inactive = 0 AND end_time > {NOW}"


@query("spawnpoint", f"SELECT id, lat, lon, despawn_sec FROM spawnpoint WHERE last_seen > {SEEN}")
def q_scan_spawnpoint_all(v: Views):
    return scans.spawnpoints(v.spawnpoint, SEEN)


@query("spawnpoint", f"SELECT id, lat, lon, despawn_sec FROM spawnpoint WHERE last_seen > {SEEN} AND despawn_sec IS NOT NULL AND {IN_BOUNDS}")
def q_scan_spawnpoint_bound(v: Views):
    return scans.spawnpoints(v.spawnpoint, SEEN, "known", bounds=BOUNDS)


@query("spawnpoint edge", f"SELECT DISTINCT id, lat, lon, despawn_sec FROM ({inside('spawnpoint', 'p.id, p.lat, p.lon, p.despawn_sec, p.last_seen')}) WHERE last_seen > {SEEN}")
def q_scan_spawnpoint_area(v: Views):
    return scans.spawnpoints(v.spawnpoint, SEEN, edges=v.edge)


@query("gym", f"SELECT id, lat, lon FROM gym WHERE {FORT}")
def q_scan_gym_all(v: Views):
    return scans.forts(v.gym, 20_000)


@query("gym", f"SELECT id, lat, lon FROM gym WHERE {FORT} AND {IN_BOUNDS}")
def q_scan_gym_bound(v: Views):
    return scans.forts(v.gym, 20_000, bounds=BOUNDS)


@query("gym edge", f"SELECT DISTINCT id, lat, lon FROM ({inside('(SELECT * FROM gym WHERE ' + FORT + ')')})")
def q_scan_gym_area(v: Views):
    return scans.forts(v.gym, 20_000, edges=v.edge)


@query("pokestop", f"SELECT id, lat, lon FROM pokestop WHERE {FORT}")
def q_scan_pokestop_all(v: Views):
    return scans.forts(v.pokestop, 20_000)


@query("pokestop", f"SELECT id, lat, lon FROM pokestop WHERE {FORT} AND {IN_BOUNDS}")
def q_scan_pokestop_bound(v: Views):
    return scans.forts(v.pokestop, 20_000, bounds=BOUNDS)


@query("pokestop edge", f"SELECT DISTINCT id, lat, lon FROM ({inside('(SELECT * FROM pokestop WHERE ' + FORT + ')')})")
def q_scan_pokestop_area(v: Views):
    return scans.forts(v.pokestop, 20_000, edges=v.edge)


@query("station", f"SELECT id, lat, lon FROM station WHERE {STATION}")
def q_scan_station_all(v: Views):
    return scans.stations(v.station, 20_000, NOW)


@query("station", f"SELECT id, lat, lon FROM station WHERE {STATION} AND {IN_BOUNDS}")
def q_scan_station_bound(v: Views):
    return scans.stations(v.station, 20_000, NOW, bounds=BOUNDS)


@query("station edge", f"SELECT DISTINCT id, lat, lon FROM ({inside('(SELECT * FROM station WHERE ' + STATION + ')')})")
def q_scan_station_area(v: Views):
    return scans.stations(v.station, 20_000, NOW, edges=v.edge)


@query("gym pokestop station edge", f"SELECT DISTINCT id, lat, lon FROM ({inside(f'(SELECT id, lat, lon FROM gym WHERE {FORT} UNION ALL SELECT id, lat, lon FROM pokestop WHERE {FORT} UNION ALL SELECT id, lat, lon FROM station WHERE {STATION})')})")
def q_scan_fort(v: Views):
    return scans.forts(v.gym, 20_000, edges=v.edge).unionByName(scans.forts(v.pokestop, 20_000, edges=v.edge)).unionByName(scans.stations(v.station, 20_000, NOW, edges=v.edge))


@query("geofence", "SELECT id, name, parent, mode, geo_type FROM geofence")
def q_scan_geofence_all(v: Views):
    return v.geofence


@query("geofence", "SELECT id, name, mode FROM geofence ORDER BY name")
def q_scan_geofence_ref(v: Views):
    return v.geofence.select("id", "name", "mode").orderBy("name")


@query("route", "SELECT id, name, mode, 'MultiPoint' AS geo_type FROM route ORDER BY name")
def q_scan_route_ref(v: Views):
    return v.route.select("id", "name", "mode", F.lit("MultiPoint").alias("geo_type")).orderBy("name")


@query("instance", "SELECT id, name, CASE WHEN type='leveling' THEN 'Point' WHEN type LIKE 'circle_%' THEN 'MultiPoint' ELSE 'MultiPolygon' END AS geo_type FROM instance ORDER BY name")
def q_scan_instance_cache(v: Views):
    kind = F.when(F.col("type") == "leveling", "Point").when(F.col("type").like("circle_%"), "MultiPoint").otherwise("MultiPolygon")
    return v.instance.select("id", "name", kind.alias("geo_type")).orderBy("name")


@query("instance", "SELECT id, name, type FROM instance WHERE type = 'auto_quest'")
def q_scan_instance_all(v: Views):
    return v.instance.where("type = 'auto_quest'").select("id", "name", "type")


_AREA_REF = " UNION ALL ".join(f"SELECT id, name, '{m}' AS mode FROM area WHERE {c} IS NOT NULL AND {c} <> ''" for c, m in (("geofence", "auto_quest"), ("fort_mode_route", "circle_raid"), ("pokemon_mode_route", "circle_pokemon"), ("quest_mode_route", "circle_quest")))


@query("area", _AREA_REF)
def q_scan_area_ref(v: Views):
    return scans.area_references(v.area)


@query("geofence route", "SELECT id, name, mode FROM geofence UNION ALL SELECT id, name, mode FROM route")
def q_scan_union_refs(v: Views):
    return v.geofence.select("id", "name", "mode").unionByName(v.route.select("id", "name", "mode"))


@query("spawnpoint", "SELECT 'all' AS tth, count(*) AS n FROM spawnpoint UNION ALL SELECT 'known', count(*) FROM spawnpoint WHERE despawn_sec IS NOT NULL UNION ALL SELECT 'unknown', count(*) FROM spawnpoint WHERE despawn_sec IS NULL")
def q_flt_tth(v: Views):
    one = lambda t: v.spawnpoint.where(scans.with_tth(t)).agg(F.lit(t).alias("tth"), F.count("*").alias("n"))
    return one("all").unionByName(one("known")).unionByName(one("unknown")).select("tth", "n")


@query("gym", f"SELECT id FROM gym WHERE {IN_BOUNDS}")
def q_flt_bbox(v: Views):
    return v.gym.where(scans.in_bounds(*BOUNDS)).select("id")


@query("spawnpoint fence", "SELECT DISTINCT p.id FROM spawnpoint p JOIN fence f ON p.lon BETWEEN f.x0 AND f.x1 AND p.lat BETWEEN f.y0 AND f.y1")
def q_flt_area_bbox_or(v: Views):
    from terracover.operators.joins import fence_cover

    step = 0.005
    cells = fence_cover(v.edge, step).drop("edges")
    p = v.spawnpoint.select("id", "lat", "lon", F.floor(F.col("lon") / step).alias("gx"), F.floor(F.col("lat") / step).alias("gy"))
    return p.join(cells, ["gx", "gy"]).where("lon between x0 and x1 and lat between y0 and y1").select("id").distinct()


@query("geofence", "SELECT id, name FROM geofence WHERE name ILIKE '%an%'")
def q_flt_name_like(v: Views):
    return v.geofence.where(F.col("name").ilike("%an%")).select("id", "name")


@query("geofence geofence_project", "SELECT id, name FROM geofence WHERE parent = 102 AND geo_type = 'Polygon' AND id IN (SELECT geofence_id FROM geofence_project WHERE project_id = 1)")
def q_flt_geofence_admin(v: Views):
    return catalog.geofence_filter(v.geofence, v.geofence_project, parent=102, geo_type="Polygon", project=1).select("id", "name")


@query("geofence geofence_project", "SELECT id, name FROM geofence WHERE parent IS NOT NULL AND id NOT IN (SELECT geofence_id FROM geofence_project)")
def q_join_geofence_project_anti(v: Views):
    return catalog.geofence_filter(v.geofence, v.geofence_project, project=0).where("parent is not null").select("id", "name")


@query("route", "SELECT id, points FROM route WHERE points BETWEEN 2 AND 80 UNION ALL SELECT -id, points FROM route WHERE points > 70 UNION ALL SELECT -1000-id, points FROM route WHERE points < 60")
def q_flt_route_points_range(v: Views):
    part = lambda low, high, key: v.route.where(catalog.points_range(low, high)).select(key.alias("id"), "points")
    return part(2, 80, F.col("id")).unionByName(part(70, None, -F.col("id"))).unionByName(part(None, 60, -1000 - F.col("id")))


@query("geofence", "SELECT id, name FROM geofence WHERE parent = (SELECT id FROM geofence WHERE name = 'ASIA')")
def q_flt_by_parent(v: Views):
    up = v.geofence.where(catalog.id_or_name("ASIA")).select(F.col("id").alias("parent"))
    return v.geofence.join(up, "parent", "left_semi").select("id", "name")


@query("route", "SELECT id, name FROM route WHERE geofence_id = 3 OR name = 'route 4' ORDER BY name")
def q_flt_route_by_geofence(v: Views):
    return v.route.where((F.col("geofence_id") == 3) | (F.col("name") == "route 4")).select("id", "name").orderBy("name")


@query("project", "SELECT id, name FROM project WHERE scanner AND api_endpoint IS NOT NULL ORDER BY id LIMIT 1")
def q_flt_scanner_project(v: Views):
    return v.project.where("scanner and api_endpoint is not null").orderBy("id").select("id", "name").limit(1)


@query("geofence", "SELECT g.id, g.name FROM geofence g LEFT JOIN geofence p ON g.parent = p.id WHERE g.name NOT IN ('FRANCE', 'CHINA') AND (p.name IS NULL OR p.name NOT IN ('ASIA'))")
def q_flt_exclude(v: Views):
    return catalog.excluded(v.geofence, "FRANCE,CHINA", "ASIA").select("id", "name")


_VALUES = "pv AS (SELECT gp.geofence_id, p.name, p.category, CASE WHEN p.category='database' THEN CASE p.name WHEN 'name' THEN g.name WHEN 'mode' THEN g.mode WHEN 'geo_type' THEN g.geo_type WHEN 'parent' THEN CAST(g.parent AS VARCHAR) END ELSE coalesce(gp.value, p.default_value) END AS value FROM geofence_property gp JOIN property p ON gp.property_id = p.id JOIN geofence g ON gp.geofence_id = g.id)"


def _with(cte: str, views: str, sql: str) -> tuple[str, str]:
    """The views and a query over one more common table."""
    return views, f"SELECT * FROM (WITH {cte} {sql})"


@query(*_with(_VALUES, "geofence property geofence_property", "SELECT geofence_id, name, category, value FROM pv"))
def q_join_geofence_properties(v: Views):
    return catalog.property_values(v.geofence_property, v.property, v.geofence)


@query(*_with(_VALUES, "geofence property geofence_property", "SELECT geofence_id, string_agg(concat(name, '=', coalesce(value, 'null')), ';' ORDER BY name) AS properties FROM pv GROUP BY geofence_id"))
def q_prj_feature_props(v: Views):
    maps = catalog.property_maps(catalog.property_values(v.geofence_property, v.property, v.geofence))
    return maps.select("geofence_id", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";").alias("properties"))


@query(*_with(_VALUES, "geofence property geofence_property", "SELECT g.id, coalesce(g.name, '') || '|' || coalesce((SELECT count(*) FROM pv WHERE pv.geofence_id = g.id AND pv.name NOT LIKE '\\_\\_%' ESCAPE '\\'), 0) AS kept FROM geofence g"))
def q_prj_strip_internal(v: Views):
    full = catalog.features(v.geofence, catalog.property_values(v.geofence_property, v.property, v.geofence), internal=True)
    kept = full.select("id", F.size(catalog.strip_internal(F.col("properties"))).alias("n"))
    return v.geofence.join(kept, "id").select("id", F.concat("name", F.lit("|"), F.col("n").cast("string")).alias("kept"))


@query("geofence", "SELECT id, name AS \"__name\", CASE WHEN geo_type = 'Point' THEN 'leveling' WHEN geo_type = 'MultiPoint' THEN 'circle_pokemon' ELSE 'auto_quest' END AS \"__mode\" FROM geofence")
def q_prj_instance_props(v: Views):
    return v.geofence.select("id", F.col("name").alias("__name"), props.default_mode(F.col("geo_type")).alias("__mode"))


@query("geofence", "SELECT id, name FROM geofence WHERE id = 7 OR name = 'CHINA'")
def q_lookup_id_or_name(v: Views):
    return v.geofence.where(catalog.id_or_name("7") | catalog.id_or_name("CHINA")).select("id", "name")


@query("spawnpoint", "SELECT concat(CASE WHEN despawn_sec IS NULL THEN 'u' ELSE 'v' END, CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR)) AS i, lat, lon FROM spawnpoint")
def q_prj_enumerate(v: Views):
    return catalog.enumerated(v.spawnpoint, F.when(F.col("despawn_sec").isNull(), "u").otherwise("v"), "id")


@query("geofence geofence_project project", "SELECT g.id, g.name FROM geofence g JOIN geofence_project b ON g.id = b.geofence_id JOIN project p ON p.id = b.project_id WHERE p.name = 'beta' ORDER BY g.name")
def q_join_geofence_project(v: Views):
    return catalog.of_project(v.geofence, v.geofence_project, v.project, "beta").select("id", "name").orderBy("name")


@query("geofence", "SELECT g.id, p.name AS parent_name FROM geofence g LEFT JOIN geofence p ON g.parent = p.id")
def q_join_geofence_parent(v: Views):
    none = v.geofence.select(F.col("id").alias("geofence_id"), F.lit("").alias("name"), F.lit("").alias("value")).where("false")
    return catalog.parent_names(v.geofence, none)


@query("route geofence", "SELECT r.id, r.name, g.name AS fence FROM route r LEFT JOIN geofence g ON r.geofence_id = g.id WHERE g.name = 'JAPAN'")
def q_join_route_geofence(v: Views):
    g = v.geofence.select(F.col("id").alias("geofence_id"), F.col("name").alias("fence"))
    return v.route.join(g, "geofence_id").where("fence = 'JAPAN'").select("id", "name", "fence")


@query("geofence geofence_project", "SELECT g.id, coalesce(string_agg(CAST(b.project_id AS VARCHAR), ',' ORDER BY b.project_id), '') AS related FROM geofence g LEFT JOIN geofence_project b ON g.id = b.geofence_id GROUP BY g.id")
def q_join_related_lists(v: Views):
    return catalog.related(v.geofence, v.geofence_project, "geofence_id", "project_id").select("id", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"))


@query("geofence geofence_project", "SELECT g.id, CAST(count(b.project_id) AS INT) AS n FROM geofence g LEFT JOIN geofence_project b ON g.id = b.geofence_id GROUP BY g.id ORDER BY n DESC, g.id LIMIT 10")
def q_sort_related_len(v: Views):
    lists = catalog.related(v.geofence, v.geofence_project, "geofence_id", "project_id")
    return lists.select("id", F.size("related").alias("n")).orderBy(F.desc("n"), "id").limit(10)


@query("geofence route", "SELECT id, name FROM geofence WHERE id IN (SELECT parent FROM geofence) UNION ALL SELECT id, name FROM geofence WHERE id IN (SELECT geofence_id FROM route)")
def q_join_semi_in(v: Views):
    g = v.geofence
    up = g.join(g.select(F.col("parent").alias("id")), "id", "left_semi")
    return up.unionByName(g.join(v.route.select(F.col("geofence_id").alias("id")), "id", "left_semi")).select("id", "name")


@query("geofence", "SELECT * FROM (SELECT id, name, (SELECT count(*) FROM geofence) AS total, CAST(2 AS BIGINT) AS pages, false AS has_next, true AS has_prev FROM geofence ORDER BY name DESC, id LIMIT 25 OFFSET 25)")
def q_paginate(v: Views):
    return catalog.paginate(v.geofence.select("id", "name"), "name", True, 1, 25)


@query("route", "SELECT count(*) AS total, CAST(ceil(count(*) / CAST(10 AS DOUBLE)) AS BIGINT) AS pages FROM route")
def q_agg_paginate_total(v: Views):
    return v.route.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 10).alias("pages"))


@query("geofence", "SELECT DISTINCT parent FROM geofence WHERE parent IS NOT NULL")
def q_agg_distinct(v: Views):
    return v.geofence.select("parent").where("parent is not null").distinct()


def _incoming_fences(v: Views):
    return v.geofence.where("id % 4 = 1").select((F.col("id") + F.when(F.col("id") % 8 == 1, 1000).otherwise(0)).alias("id"), F.concat("name", F.lit(" new")).alias("name"), F.lit(None).cast("string").alias("mode"))


@query("geofence", "SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, o.mode, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS action FROM geofence o FULL JOIN (SELECT id + CASE WHEN id%8=1 THEN 1000 ELSE 0 END AS id, name || ' new' AS name FROM geofence WHERE id%4=1) n ON o.id = n.id")
def q_sink_geofence_upsert(v: Views):
    return catalog.upsert(v.geofence, _incoming_fences(v), ["id"], ["name", "mode"])


@query("route", "SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.name IS NULL THEN 'insert' WHEN n.name IS NULL THEN 'keep' ELSE 'update' END AS action FROM route o FULL JOIN (SELECT name, CASE WHEN id%3=0 THEN 'circle_quest' ELSE mode END AS mode FROM route WHERE id<12) n ON o.name = n.name AND o.mode = n.mode) GROUP BY action")
def q_sink_route_upsert(v: Views):
    new = v.route.where("id < 12").select("name", F.when(F.col("id") % 3 == 0, "circle_quest").otherwise(F.col("mode")).alias("mode"), "points")
    return catalog.upsert(v.route, new, ["name", "mode"], ["points"]).groupBy("action").agg(F.count("*").alias("n"))


@query("instance", "SELECT o.id, CASE WHEN n.id IS NULL THEN o.data ELSE '1,2' END AS data FROM instance o LEFT JOIN (SELECT id FROM instance WHERE type = 'auto_quest' AND id < 12) n ON o.id = n.id")
def q_sink_instance_upsert(v: Views):
    new = v.instance.where("type = 'auto_quest' and id < 12").select("id", F.lit("1,2").alias("data"))
    return catalog.upsert(v.instance, new, ["id"], ["data"]).select("id", "data")


@query("area route_point", "SELECT a.id, CASE WHEN r.t IS NULL THEN a.fort_mode_route ELSE r.t END AS fort_mode_route FROM area a LEFT JOIN (SELECT fid, string_agg(printf('%.6f %.6f', lat, lon), ',' ORDER BY seq) AS t FROM route_point WHERE fid % 4 = 0 GROUP BY fid) r ON a.id = r.fid")
def q_sink_area_upsert(v: Views):
    text = v.route_point.where("fid % 4 = 0").groupBy(F.col("fid").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.format_string("%.6f %.6f", "lat", "lon").alias("t")))), lambda x: x["t"]), ",").alias("fort_mode_route")
    )
    return catalog.upsert(v.area, text, ["id"], ["fort_mode_route"]).select("id", "fort_mode_route")


@query("geofence_project", "SELECT CAST(geofence_id AS BIGINT) AS geofence_id, project_id, 'delete' AS action FROM geofence_project WHERE geofence_id < 6 AND project_id <> 2 UNION ALL SELECT g, 2, 'insert' FROM (SELECT DISTINCT geofence_id AS g FROM geofence_project WHERE geofence_id < 6) WHERE g NOT IN (SELECT geofence_id FROM geofence_project WHERE project_id = 2)")
def q_sink_set_sync(v: Views):
    want = v.geofence_project.where("geofence_id < 6").select("geofence_id").distinct().withColumn("project_id", F.lit(2))
    return catalog.set_sync(v.geofence_project, want, "geofence_id", "project_id")


@query("geofence_property property", "SELECT geofence_id, property_id, value FROM geofence_property WHERE geofence_id >= 5 UNION ALL SELECT gp.geofence_id, gp.property_id, CASE WHEN p.category = 'database' THEN NULL ELSE coalesce(CASE WHEN gp.property_id % 2 = 0 THEN 'x' END, p.default_value) END FROM geofence_property gp JOIN property p ON p.id = gp.property_id WHERE gp.geofence_id < 5 AND gp.property_id < 6")
def q_sink_property_sync(v: Views):
    new = v.geofence_property.where("geofence_id < 5 and property_id < 6").select("geofence_id", "property_id", F.when(F.col("property_id") % 2 == 0, "x").alias("value"))
    return catalog.property_sync(v.geofence_property, new, v.property)


@query("geofence_property", "SELECT geofence_id, property_id, CASE WHEN property_id = 3 THEN '5' ELSE value END AS value FROM geofence_property")
def q_sink_property_recast(v: Views):
    return catalog.recast(v.geofence_property, v.property, 3)


@query("geofence", "SELECT id, CASE WHEN id = 4 THEN NULL WHEN id = 5 THEN 101 ELSE parent END AS parent FROM geofence")
def q_sink_assign_parent(v: Views):
    return catalog.assign_parent(catalog.assign_parent(v.geofence, 4, 0), 5, 101).select("id", "parent")


@query("geofence_property", "SELECT geofence_id, property_id FROM geofence_property WHERE geofence_id NOT IN (1, 2, 3)")
def q_sink_delete(v: Views):
    return catalog.deleted(v.geofence_property, [1, 2, 3], "geofence_id").select("geofence_id", "property_id")


@query("area", "SELECT id, nullif(geofence, '') AS geofence, CASE WHEN coalesce(geofence, '') = '' THEN 'geofence is required' WHEN fort_mode_route IS NULL THEN 'fort_mode_route is required' END AS error FROM area")
def q_sink_validate(v: Views):
    return catalog.validated(v.area, ["geofence", "fort_mode_route"]).select("id", "geofence", "error")


_EVENT_KEYS = "SELECT k AS name, CASE WHEN lower(x) IN ('true','false') THEN 'boolean' WHEN try_cast(x AS DOUBLE) IS NOT NULL THEN 'number' WHEN x LIKE '[%' THEN 'array' WHEN x LIKE '{%' THEN 'object' WHEN x LIKE '#%' OR x LIKE 'rgb%' THEN 'color' ELSE 'string' END AS category, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k, props FROM events) t, LATERAL (SELECT trim(json_extract_string(props, '$.\"' || k || '\"')) AS x) GROUP BY 1, 2"


@query(sql=_EVENT_KEYS)
def q_etl_property_backfill(v: Views):
    events = v.spark.read.parquet(f"{v.sf_dir}/events.parquet")
    return catalog.property_backfill(events.select(F.concat(F.lit('{"properties":'), F.col("props"), F.lit("}")).alias("feature")))


@query("instance", "SELECT id, CASE type WHEN 'auto_quest' THEN 'AQ' WHEN 'circle_pokemon' THEN 'CP' WHEN 'pokemon_iv' THEN 'IV' WHEN 'leveling' THEN 'L' END AS acronym, CASE WHEN id % 2 = 0 THEN 'auto_quest' ELSE type END AS mode FROM instance")
def q_etl_mode_normalise(v: Views):
    legacy = F.when(F.col("id") % 2 == 0, "AutoQuest").otherwise(F.col("type"))
    return v.instance.select("id", props.mapped(F.col("type"), props.ACRONYMS).alias("acronym"), props.mapped(legacy, props.LEGACY_MODES, legacy).alias("mode"))


@query("fence", "SELECT fid, 'Polygon' AS geo_type, CAST(4 AS INT) AS points FROM fence")
def q_fn_json_path(v: Views):
    doc = F.format_string('{"geometry":{"type":"Polygon","coordinates":[[%s,1],[2,2],[3,3],[4,4]]}}', F.col("fid").cast("string"))
    return v.fence.select("fid", doc.alias("d")).select("fid", F.get_json_object("d", "$.geometry.type").alias("geo_type"), F.json_array_length(F.get_json_object("d", "$.geometry.coordinates")).alias("points"))


@query("pokestop", "SELECT id, concat(upper(substr(m, 1, 1)), substr(m, 2)) AS name FROM (SELECT id, concat('up ', lower(replace(substr(name, 3), ' ', '_'))) AS m FROM pokestop)")
def q_fn_name_modifier(v: Views):
    step = names.modify(F.col("name"), trimstart=2, lowercase=True, space="_")
    return v.pokestop.select("id", names.modify(step, F.lit("up"), parentstart=" ", capfirst=True).alias("name"))


@query("geofence_property property", "SELECT gp.geofence_id, gp.property_id, CASE WHEN p.category IN ('string','color') THEN CASE WHEN value IS NULL THEN NULL ELSE concat('\"', value, '\"') END WHEN p.category = 'number' THEN CAST(CAST(coalesce(try_cast(value AS DOUBLE), 0) AS BIGINT) AS VARCHAR) || '.0' WHEN p.category = 'boolean' THEN CASE WHEN lower(value) = 'true' THEN 'true' ELSE 'false' END WHEN p.category IN ('array','object') THEN value END AS json FROM geofence_property gp JOIN property p ON p.id = gp.property_id")
def q_fn_property_cast(v: Views):
    p = v.property.select(F.col("id").alias("property_id"), "category")
    text = props.cast_text(F.col("value"), F.col("category"))
    return v.geofence_property.join(p, "property_id").select("geofence_id", "property_id", F.when(F.col("value").isNotNull() | ~F.col("category").isin("string", "color"), text).alias("json"))


@query("geofence_property", "SELECT geofence_id, property_id, CASE WHEN value IS NULL THEN 'string' WHEN lower(value) IN ('true','false') THEN 'boolean' WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 'number' WHEN value LIKE '[%' THEN 'array' WHEN value LIKE '{%' THEN 'object' WHEN value LIKE '#%' THEN 'color' ELSE 'string' END AS category FROM geofence_property")
def q_fn_property_infer(v: Views):
    return v.geofence_property.select("geofence_id", "property_id", props.infer(F.col("value")).alias("category"))


@query("geofence", "SELECT id, len(string_split(name, 'A')) AS n, string_split(name, 'A')[1] AS head FROM geofence")
def q_fn_split_csv(v: Views):
    return v.geofence.select("id", F.size(F.split("name", "A")).cast("long").alias("n"), F.element_at(F.split("name", "A"), 1).alias("head"))


@query("spawnpoint edge", f"SELECT fid, count(*) AS n FROM ({inside('spawnpoint')}) GROUP BY fid")
def q_agg_count_in_area(v: Views):
    return pip_join(v.spawnpoint, v.edge, ["id"]).groupBy("fid").agg(F.count("*").alias("n"))
