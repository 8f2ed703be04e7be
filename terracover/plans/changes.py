"""Queries of mutations over several tables: one per case and table reached."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracover.operators import mutations
from terracover.plans.registry import Views, query

# Fences that come in, by their number: known ids with new names and a project (0 of 4), known names with a parent by id (1), unknown
# names with a parent by name and properties (2), unknown ids with an empty set of projects (3).
_IN = "SELECT fid, fid % 4 AS kind, name FROM fence WHERE fid > 0"  # an id of 0 is none
_NEW = f"SELECT fid, name, 104 + row_number() OVER (ORDER BY fid) AS id FROM ({_IN}) WHERE kind >= 2"
_TARGET = f"SELECT i.fid, i.kind, coalesce(n.id, i.fid) AS id FROM ({_IN}) i LEFT JOIN ({_NEW}) n ON n.fid = i.fid"


def _fences(v: Views):
    kind = F.col("fid") % 4
    entry = lambda name, category, value: F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), value.cast("string").alias("value"))
    incoming = v.fence.where("fid > 0").select(
        F.col("fid").alias("seq"),
        F.when(kind == 0, F.col("fid")).when(kind == 1, F.lit(0)).when(kind == 3, F.col("fid") + 5000).cast("long").alias("id"),
        F.when(kind == 0, F.concat("name", F.lit(" new"))).when(kind == 1, F.col("name")).otherwise(F.concat(F.lit("zone "), F.col("fid").cast("string"))).alias("name"),
        F.when(kind == 1, "leveling").alias("mode"),
        F.when(kind >= 2, "Polygon").alias("geo_type"),
        F.when(kind == 0, F.array(F.lit(1).cast("long"))).when(kind == 3, F.expr("cast(array() as array<bigint>)")).alias("projects"),
        F.when(kind == 1, F.lit("103")).when(kind == 2, F.lit("ASIA")).alias("parent"),
        F.when(kind == 2, F.array(entry("color", "color", F.lit("#123456")), entry("speed", "number", F.col("fid")))).alias("properties"),
    )
    tables = {t: getattr(v, t) for t in ("geofence", "geofence_project", "property", "geofence_property")}
    named = v.route.join(v.fence.select(F.col("fid").alias("geofence_id"), F.col("name").alias("own")), "geofence_id")
    tables["route"] = named.select("id", "geofence_id", F.when(F.col("id") % 3 == 0, F.col("own")).otherwise(F.col("name")).alias("name"), "mode")
    return mutations.fences_upserted(tables, incoming)


_CHANGED = f"""
SELECT g.id, CASE WHEN t.kind = 0 THEN g.name || ' new' ELSE g.name END AS name, CASE WHEN t.kind = 1 THEN 'leveling' ELSE g.mode END AS mode, g.geo_type,
  CASE WHEN t.kind = 1 THEN 103 ELSE g.parent END AS parent, CASE WHEN t.kind <= 1 THEN 'update' ELSE 'keep' END AS action
FROM geofence g LEFT JOIN ({_TARGET}) t ON t.id = g.id
UNION ALL SELECT t.id, 'zone ' || t.fid, NULL, 'Polygon', CASE WHEN t.kind = 2 THEN 102 END, 'insert' FROM ({_TARGET}) t WHERE t.kind >= 2"""


@query("fence geofence", _CHANGED)
def q_upsert_fences(v: Views):
    """By id with a new name, by name, new by an unknown name, new by an unknown id; parents by id and by name."""
    return _fences(v)["geofence"]


@query("fence geofence_project", f"SELECT geofence_id, CAST(project_id AS BIGINT) AS project_id FROM geofence_project WHERE geofence_id NOT IN (SELECT id FROM ({_TARGET}) WHERE kind = 0) UNION ALL SELECT id, 1 FROM ({_TARGET}) WHERE kind = 0")
def q_upsert_fences_projects(v: Views):
    """Sets given are made equal, others stay."""
    return _fences(v)["geofence_project"].select("geofence_id", F.col("project_id").cast("long").alias("project_id"))


@query("fence property", "SELECT CAST(id AS BIGINT) AS id, name, category, default_value FROM property UNION ALL SELECT max(id) + 1, 'speed', 'number', NULL FROM property")
def q_upsert_fences_new_properties(v: Views):
    """A property of an unknown name is added once."""
    return _fences(v)["property"]


@query(
    "fence geofence_property property",
    f"SELECT geofence_id, CAST(property_id AS BIGINT) AS property_id, value FROM geofence_property WHERE NOT (property_id = 7 AND geofence_id IN (SELECT id FROM ({_TARGET}) WHERE kind = 1))"
    f" UNION ALL SELECT id, 1, NULL FROM ({_TARGET}) WHERE kind >= 2"
    f" UNION ALL SELECT t.id, p.id, CASE p.id WHEN 2 THEN '#123456' WHEN 8 THEN CAST(t.fid AS VARCHAR) END FROM ({_TARGET}) t, (VALUES (2), (8)) AS p(id) WHERE kind = 2"
    f" UNION ALL SELECT t.id, 7, d.default_value FROM ({_TARGET}) t, (SELECT default_value FROM property WHERE name = 'parent') d WHERE kind IN (1, 2)",
)
def q_upsert_fences_values(v: Views):
    """Properties given replace a fence's, new fences get their name's, fences with a parent the parent's."""
    return _fences(v)["geofence_property"].select("geofence_id", F.col("property_id").cast("long").alias("property_id"), "value")


@query("fence route", "SELECT r.id, CASE WHEN r.id % 3 = 0 THEN CASE WHEN r.id % 4 = 0 AND r.id > 0 THEN f.name || ' new' ELSE f.name END ELSE r.name END AS name, CASE WHEN r.id % 12 = 0 AND r.id > 0 THEN 'update' ELSE 'keep' END AS action FROM route r JOIN fence f ON f.fid = r.geofence_id")
def q_upsert_fences_routes(v: Views):
    """Routes named like their fence get its new name."""
    return _fences(v)["route"].select("id", "name", "action")


# Instances: of the same name and type (0 of 4), of another type with and without an instance of that acronym (1, 2), unknown (3).


@query("instance", """SELECT * FROM (
WITH old AS (SELECT id, name, type, '{"radius":70}' AS data, 70 AS radius, CAST(NULL AS INT) AS timeout FROM instance
  UNION ALL SELECT 500 + id, name || '_IV', 'pokemon_iv', '', 80, NULL FROM instance WHERE id % 4 = 2 AND id < 12
  UNION ALL SELECT 900, 'Default_AQ', 'auto_quest', '', NULL, 5 UNION ALL SELECT 901, 'Default_leveling', 'leveling', '', NULL, 6),
inc AS (SELECT id AS seq, CASE id % 4 WHEN 3 THEN 'new ' || name WHEN 0 THEN name WHEN 1 THEN name || '_AQ' ELSE name || '_IV' END AS target,
  CASE id % 4 WHEN 0 THEN type WHEN 1 THEN 'auto_quest' WHEN 2 THEN 'pokemon_iv' ELSE 'leveling' END AS type FROM instance),
made AS (SELECT target, type, seq, 901 + row_number() OVER (ORDER BY seq) AS id FROM inc WHERE target NOT IN (SELECT name FROM old))
SELECT CAST(old.id AS BIGINT) AS id, old.name, old.type, radius, timeout, inc.seq AS lon, CASE WHEN inc.seq IS NULL THEN 'keep' ELSE 'update' END AS action FROM old LEFT JOIN inc ON inc.target = old.name
UNION ALL SELECT id, target, type, NULL, CASE type WHEN 'auto_quest' THEN 5 WHEN 'leveling' THEN 6 END, seq, 'insert' FROM made)""")
def q_upsert_instances(v: Views):
    """The three cases of a scanner instance, and what new ones start from."""
    one = v.instance
    kind = F.col("id") % 4
    old = one.select("id", "name", "type", F.lit('{"radius":70,"area":[]}').alias("data"))
    old = old.unionByName(one.where((kind == 2) & (F.col("id") < 12)).select((F.col("id") + 500).alias("id"), F.concat("name", F.lit("_IV")).alias("name"), F.lit("pokemon_iv").alias("type"), F.lit('{"area":1,"radius":80}').alias("data")))
    old = old.unionByName(one.where("id < 2").select((F.col("id") + 900).alias("id"), F.when(F.col("id") == 0, "Default_AQ").otherwise("Default_leveling").alias("name"), F.when(F.col("id") == 0, "auto_quest").otherwise("leveling").alias("type"), F.concat(F.lit('{"timeout":'), (F.col("id") + 5).cast("string"), F.lit("}")).alias("data")))
    incoming = one.select(
        F.col("id").alias("seq"), F.when(kind == 3, F.concat(F.lit("new "), F.col("name"))).otherwise(F.col("name")).alias("name"),
        F.when(kind == 0, F.col("type")).when(kind == 1, "auto_quest").when(kind == 2, "pokemon_iv").otherwise("leveling").alias("type"),
        F.concat(F.lit('[{"lat":1,"lon":'), F.col("id").cast("string"), F.lit("}]")).alias("area"),
    )
    out = mutations.instances_upserted(old, incoming)
    field = lambda path: F.get_json_object("data", path)
    return out.select("id", "name", "type", field("$.radius").cast("int").alias("radius"), field("$.timeout").cast("int").alias("timeout"), field("$.area[0].lon").cast("long").alias("lon"), "action")


@query("area", """SELECT * FROM (
WITH old AS (SELECT id, CASE WHEN id = 24 THEN 'Default' ELSE name END AS name, geofence, fort_mode_route, pokemon_mode_route, quest_mode_route FROM area),
d AS (SELECT * FROM old WHERE name = 'Default')
SELECT id, name, CASE WHEN id % 4 = 0 AND id < 24 THEN 'g' || id ELSE geofence END AS geofence, CASE WHEN id % 4 = 1 THEN 'f' || id ELSE fort_mode_route END AS fort_mode_route, pokemon_mode_route,
  CASE WHEN id % 4 = 0 AND id < 24 THEN 'q' || id ELSE quest_mode_route END AS quest_mode_route, CASE WHEN id % 4 <= 1 AND id < 24 THEN 'update' ELSE 'keep' END AS action FROM old
UNION ALL SELECT 24 + row_number() OVER (ORDER BY o.id), 'new ' || o.name, d.geofence, d.fort_mode_route, 'p' || o.id, d.quest_mode_route, 'insert' FROM old o, d WHERE o.id % 4 = 2)""")
def q_upsert_areas(v: Views):
    """Two columns of one area, one of another, and new areas from the Default's columns; rows without a mode change nothing."""
    old = v.area.withColumn("name", F.when(F.col("id") == 24, "Default").otherwise(F.col("name"))).select("id", "name", "geofence", "fort_mode_route", "pokemon_mode_route", "quest_mode_route")
    kind, text = F.col("id") % 4, F.col("id").cast("string")
    rows = F.when((kind == 0) & (F.col("id") < 24), F.array(F.struct(F.lit("AutoQuest").alias("mode"), F.concat(F.lit("g"), text).alias("area")), F.struct(F.lit("CircleQuest").alias("mode"), F.concat(F.lit("q"), text).alias("area"))))
    rows = rows.when(kind == 1, F.array(F.struct(F.lit("circle_smart_raid").alias("mode"), F.concat(F.lit("f"), text).alias("area"))))
    rows = rows.when(kind == 2, F.array(F.struct(F.lit("circle_pokemon").alias("mode"), F.concat(F.lit("p"), text).alias("area"))))
    rows = rows.when(kind == 3, F.array(F.struct(F.lit(None).cast("string").alias("mode"), F.lit("lost").alias("area"))))
    name = F.when(kind == 2, F.concat(F.lit("new "), F.col("name"))).otherwise(F.col("name"))
    return mutations.areas_upserted(old, old.select(F.col("id").alias("seq"), name.alias("name"), F.inline(rows)))


@query("route fence", """SELECT * FROM (
WITH inc AS (SELECT fid AS seq, fid % 4 AS kind, name FROM fence), r AS (SELECT id, geofence_id, name, mode, points FROM route), top AS (SELECT max(id) AS id FROM r),
made AS (SELECT seq, seq AS geofence_id, CASE kind WHEN 1 THEN 'route ' || seq ELSE name END AS name, CASE kind WHEN 1 THEN 'pokemon_iv' ELSE 'circle_raid' END AS mode FROM inc WHERE kind IN (1, 2))
SELECT r.id, r.geofence_id, r.name, r.mode, CASE WHEN r.id % 4 = 0 THEN 1000 + r.id ELSE points END AS points, CASE WHEN r.id % 4 = 0 THEN 'update' ELSE 'keep' END AS action FROM r
UNION ALL SELECT top.id + row_number() OVER (ORDER BY seq), geofence_id, name, mode, 1000 + seq, 'insert' FROM made, top
UNION ALL SELECT NULL, NULL, 'nowhere ' || seq, 'circle_raid', 1000 + seq, 'refused' FROM inc WHERE kind = 3)""")
def q_upsert_routes(v: Views):
    """Of the same name and mode, of another mode on a fence given, by the fence's name, and without a fence."""
    kind, text = F.col("fid") % 4, F.col("fid").cast("string")
    known = v.route.select(F.col("id").alias("fid"), "mode").withColumnRenamed("mode", "own")
    incoming = v.fence.join(known, "fid", "left").where((kind != 0) | F.col("own").isNotNull()).select(
        F.col("fid").alias("seq"), F.when(kind <= 1, F.col("fid")).alias("geofence_id"),
        F.when(kind <= 1, F.concat(F.lit("route "), text)).when(kind == 2, F.col("name")).otherwise(F.concat(F.lit("nowhere "), text)).alias("name"),
        F.when(kind == 0, F.col("own")).when(kind == 1, "pokemon_iv").otherwise("circle_raid").alias("mode"), (F.col("fid") + 1000).alias("points"),
    )
    return mutations.routes_upserted(v.route, incoming, v.fence.select(F.col("fid").alias("id"), "name"))


def _deleted(v: Views):
    """Every fifth fence, and two regions: one is still a parent, the other's fences all go with it."""
    ids = v.fence.where("fid % 5 = 2 or parent = 104").select(F.col("fid").alias("id")).unionByName(v.geofence.where("id in (103, 104)").select("id"))
    tables = {t: getattr(v, t) for t in ("geofence", "geofence_project", "geofence_property", "route")}
    return mutations.fences_deleted(tables, ids)


_OUT = "SELECT fid AS id FROM fence WHERE fid % 5 = 2 OR parent = 104 UNION ALL SELECT 104"


@query("fence geofence", f"SELECT id, name, id = 103 AS refused FROM geofence WHERE id NOT IN ({_OUT})")
def q_delete_fences(v: Views):
    return _deleted(v)["geofence"].select("id", "name", "refused")


@query("fence geofence_project", f"SELECT geofence_id, project_id FROM geofence_project WHERE geofence_id NOT IN ({_OUT})")
def q_delete_fences_projects(v: Views):
    return _deleted(v)["geofence_project"].select("geofence_id", "project_id")


@query("fence geofence_property", f"SELECT geofence_id, property_id, value FROM geofence_property WHERE geofence_id NOT IN ({_OUT})")
def q_delete_fences_values(v: Views):
    return _deleted(v)["geofence_property"].select("geofence_id", "property_id", "value")


@query("fence route", f"SELECT id, name FROM route WHERE geofence_id NOT IN ({_OUT})")
def q_delete_fences_routes(v: Views):
    return _deleted(v)["route"].select("id", "name")
