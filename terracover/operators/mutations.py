"""Mutations that reach several tables: keys resolved in stages, templates for new rows, cascades.

Each call takes whole tables and the incoming rows, and gives whole new tables. Incoming rows have their
order as `seq`: of several for one key the first may insert a row and each field takes its last value
that is not null. Keys meet in equi-joins; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.functions import props
from terracover.operators.catalog import set_sync
from terracover.operators.grouping import numbered, settled


def _last(column: str) -> Column:
    """The last value that is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def _with_new_ids(rows: DataFrame, table: DataFrame, order: str) -> DataFrame:
    """rows with an id each, above the table's, in order."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("__top"))
    return numbered(rows, order, "__n").crossJoin(F.broadcast(top)).withColumn("id", F.col("__top") + F.col("__n") + 1).drop("__n", "__top")


def _as_id(name: Column) -> Column:
    """A name that is a number stands for an id."""
    return F.when(name.rlike("^[0-9]{1,18}$"), name.cast("long"))


def _by_id_or_name(rows: DataFrame, key: str, table: DataFrame, found: str) -> DataFrame:
    """rows with the id of the table's row that the key names, by id where it is a number, else by name."""
    by_id = table.select(F.col("id").alias("__id"), F.col("id").alias("__a"))
    by_name = table.select(F.col("name").alias("__name"), F.col("id").alias("__b"))
    number = _as_id(F.col(key))
    out = rows.join(by_id, number == F.col("__id"), "left").join(by_name, number.isNull() & (F.col(key) == F.col("__name")), "left")
    return out.withColumn(found, F.coalesce("__a", "__b")).drop("__id", "__a", "__name", "__b")


def fences_upserted(tables: dict[str, DataFrame], incoming: DataFrame, columns: tuple[str, ...] = ("mode", "geo_type")) -> dict[str, DataFrame]:
    """The tables geofence, geofence_project, property, geofence_property and route after an upsert of fences.

    incoming: seq, id, name, columns..., projects array<long>, parent (an id or a name), properties
    array<struct<name, category, value>>. A row with an id changes the fence of that id; one without (null or
    0) that of its name; any other makes a fence, with the `name` property. A changed name is carried over to
    the fence's routes of the old name. Projects, where given, replace the fence's set; properties, where
    given, replace its properties, and those of unknown names are added. Parents are looked up last, among new
    fences too; one that is not found changes nothing. geofence and route have an action column.
    """
    fences, bridge, properties, values, routes = (tables[t] for t in ("geofence", "geofence_project", "property", "geofence_property", "route"))
    named_id = F.col("id").isNotNull() & (F.col("id") != 0)
    own = incoming.where(named_id).join(fences.select("id", F.col("id").alias("target")), "id", "left")
    free = _by_id_or_name(incoming.where(~F.coalesce(named_id, F.lit(False))), "name", fences, "target")
    rows = settled(own.unionByName(free).drop("id"))
    new = _with_new_ids(rows.where("target is null").groupBy("name").agg(F.min("seq").alias("first")), fences, "first").select("name", F.col("id").alias("made"))
    rows = rows.join(new, "name", "left").withColumn("target", F.coalesce("target", "made"))

    fields = ("name", *columns, "projects", "parent", "properties")
    last = settled(rows.groupBy("target").agg(*(_last(c) for c in fields), F.max("made").isNotNull().alias("made")))
    come = last.select(F.col("target").alias("id"), *(F.col(c).alias(f"n_{c}") for c in ("name", *columns)), F.col("parent").alias("up"), F.lit(True).alias("comes"))
    both = fences.join(come, "id", "full").withColumn("was", F.col("name").isNotNull())
    action = F.when(~F.col("was"), "insert").when(F.col("comes"), "update").otherwise("keep")
    table = both.select("id", F.coalesce("n_name", "name").alias("name"), F.col("name").alias("old"), *(F.coalesce(f"n_{c}", c).alias(c) for c in columns), "parent", "up", action.alias("action"))
    ups = _by_id_or_name(table.where("up is not null").select("id", "up"), "up", table.select("id", "name"), "found").select("id", "found")
    fences_now = table.join(ups, "id", "left").withColumn("parent", F.coalesce("found", "parent"))

    renamed = fences_now.where("old is not null and old <> name").select(F.col("id").alias("geofence_id"), F.col("old").alias("name"), F.col("name").alias("renamed"))
    routes_now = routes.join(renamed, ["geofence_id", "name"], "left").withColumn("action", F.when(F.col("renamed").isNotNull(), "update").otherwise("keep")).withColumn("name", F.coalesce("renamed", "name"))

    want = last.where("projects is not null").select(F.col("target").alias("geofence_id"), F.explode_outer("projects").alias("project_id"))
    changes = set_sync(bridge.select(F.col("geofence_id").cast("long").alias("geofence_id"), F.col("project_id").cast("long").alias("project_id")), want, "geofence_id", "project_id")
    kept = bridge.join(changes.where("action = 'delete'"), ["geofence_id", "project_id"], "left_anti")
    bridge_now = kept.select("geofence_id", "project_id").unionByName(changes.where("action = 'insert'").select("geofence_id", "project_id"))

    entries = last.select("target", F.inline("properties")).withColumnRenamed("name", "prop")
    auto = last.where("made").select("target", F.lit("name").alias("prop")).unionByName(fences_now.where("found is not null").select(F.col("id").alias("target"), F.lit("parent").alias("prop")))
    auto = auto.select("target", "prop", F.lit("database").alias("category"), F.lit(None).cast("string").alias("value"))
    asked = entries.select("target", "prop", "category", "value").unionByName(auto)
    unknown = asked.join(properties.select(F.col("name").alias("prop")), "prop", "left_anti").groupBy("prop").agg(F.min("category").alias("category"))
    added = _with_new_ids(unknown, properties, "prop").select("id", F.col("prop").alias("name"), "category", F.lit(None).cast("string").alias("default_value"))
    properties_now = properties.select(F.col("id").cast("long").alias("id"), "name", "category", "default_value").unionByName(added)
    value = F.when(F.col("category") == "database", F.lit(None)).otherwise(F.coalesce("value", "default_value"))
    put = asked.drop("category").join(properties_now.select(F.col("id").alias("property_id"), F.col("name").alias("prop"), "category", "default_value"), "prop")
    put = put.groupBy(F.col("target").alias("geofence_id"), F.col("property_id")).agg(F.max(value).alias("value"))
    replaced = last.where("properties is not null").select(F.col("target").alias("geofence_id"))
    stay = values.join(replaced, "geofence_id", "left_anti").join(put, ["geofence_id", "property_id"], "left_anti")
    values_now = stay.select("geofence_id", "property_id", "value").unionByName(put)
    return {
        "geofence": fences_now.select("id", "name", *columns, "parent", "action"), "geofence_project": bridge_now, "property": properties_now,
        "geofence_property": values_now, "route": routes_now.select(*routes.columns, "action"),
    }


def json_with(document: Column, key: str, value: Column) -> Column:
    """A JSON object's text with one key set to a JSON value; keys come sorted."""
    entries = F.parse_json(document).cast("map<string,variant>")
    others = F.map_filter(entries, lambda k, _: k != F.lit(key))
    both = F.map_concat(others, F.create_map(F.lit(key), F.parse_json(value)))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))))


def instances_upserted(instances: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, name, type, data, action): scanner instances after an upsert of (seq, name, type, area as JSON).

    An instance of the name and type gets the area. One of the name but another type is left: the area goes to
    the instance named with the type's acronym, which is made where it is not there, as an unknown name is. New
    instances start from the document of Default_<acronym>, else of Default_<type>, else empty.
    """
    short = F.coalesce(props.mapped(F.col("type"), props.ACRONYMS), F.lit("U"))
    old = instances.select("id", "name", "type", "data")
    rows = incoming.join(old.select("name", F.col("type").alias("own")), "name", "left").withColumn("short", short)
    rows = rows.withColumn("name", F.when(F.col("own").isNull() | (F.col("own") == F.col("type")), F.col("name")).otherwise(F.concat_ws("_", "name", "short")))
    one = rows.groupBy("name").agg(_last("type"), _last("short"), _last("area"), F.min("seq").alias("first"))
    default = lambda c, n: one.select("name", F.concat(F.lit("Default_"), F.col(c)).alias("d")).join(old.select(F.col("name").alias("d"), F.col("data").alias(n)), "d").select("name", n)
    full = one.join(old.select("name", F.col("id"), F.col("type").alias("o_type"), F.col("data").alias("o_data")), "name", "left")
    full = full.join(default("short", "d_short"), "name", "left").join(default("type", "d_type"), "name", "left")
    data = json_with(F.coalesce("o_data", "d_short", "d_type", F.lit("{}")), "area", F.col("area"))
    full = full.select("id", "name", F.coalesce("o_type", "type").alias("type"), data.alias("data"), "first")
    made = _with_new_ids(full.where("id is null").drop("id"), instances, "first").select("id", "name", "type", "data", F.lit("insert").alias("action"))
    changed = full.where("id is not null").select("id", "name", "type", "data", F.lit("update").alias("action"))
    rest = old.join(full.where("id is not null").select("id"), "id", "left_anti").withColumn("action", F.lit("keep"))
    return rest.unionByName(changed).unionByName(made)


#: The column of an area that a mode's text goes to; any other mode's is the fence itself.
AREA_COLUMNS = {"circle_pokemon": "pokemon_mode_route", "circle_smart_pokemon": "pokemon_mode_route", "circle_raid": "fort_mode_route", "circle_smart_raid": "fort_mode_route", "circle_quest": "quest_mode_route"}


def areas_upserted(areas: DataFrame, incoming: DataFrame) -> DataFrame:
    """Areas and their action after an upsert of (seq, name, mode, area as text) by name.

    The mode chooses the column; rows without a mode change nothing. A new area starts as a copy of the area
    named Default, where there is one.
    """
    columns = [c for c in areas.columns if c not in ("id", "name")]
    mode = F.lower(F.regexp_replace("mode", "([a-z])([A-Z])", "$1_$2"))
    target = F.coalesce(props.mapped(mode, AREA_COLUMNS), F.lit("geofence"))
    rows = incoming.where("mode is not null and name is not null").withColumn("column", target)
    put = lambda c: F.max_by("area", F.when((F.col("column") == c) & F.col("area").isNotNull(), F.col("seq"))).alias(f"n_{c}")
    routes = [c for c in columns if c == "geofence" or c in AREA_COLUMNS.values()]
    one = rows.groupBy("name").agg(*(put(c) for c in routes), F.min("seq").alias("first"))
    new = lambda c: F.coalesce(f"n_{c}", c).alias(c) if c in routes else F.col(c)
    known = areas.join(one, "name", "left").select("id", "name", *(new(c) for c in columns), F.when(F.col("first").isNotNull(), "update").otherwise("keep").alias("action"))
    blank = areas.agg(*(F.max(F.when(F.col("name") == "Default", F.struct(*columns))).getField(c).alias(c) for c in columns))
    made = _with_new_ids(one.join(areas.select("name"), "name", "left_anti"), areas, "first").crossJoin(F.broadcast(blank))
    return known.unionByName(made.select("id", "name", *(new(c) for c in columns), F.lit("insert").alias("action")))


def routes_upserted(routes: DataFrame, incoming: DataFrame, fences: DataFrame, columns: tuple[str, ...] = ("points",)) -> DataFrame:
    """(id, geofence_id, name, mode, columns..., action): routes after an upsert of (seq, geofence_id, name, mode, columns...).

    A route is known by name and mode. Its fence is the one given, else the one that has the route's name; a row
    without either comes back with the action 'refused' and no id.
    """
    by_name = fences.select("name", F.col("id").cast("long").alias("__fence"))
    rows = incoming.join(by_name, "name", "left").withColumn("geofence_id", F.coalesce("geofence_id", "__fence")).drop("__fence")
    fields = ["geofence_id", *columns]
    one = rows.where("geofence_id is not null").groupBy("name", "mode").agg(*(_last(c) for c in fields), F.min("seq").alias("first"))
    known = routes.join(one.select("name", "mode", *(F.col(c).alias(f"n_{c}") for c in fields), "first"), ["name", "mode"], "left")
    known = known.select("id", "name", "mode", *(F.coalesce(f"n_{c}", c).alias(c) for c in fields), F.when(F.col("first").isNotNull(), "update").otherwise("keep").alias("action"))
    made = _with_new_ids(one.join(routes.select("name", "mode"), ["name", "mode"], "left_anti"), routes, "first").select("id", "name", "mode", *fields, F.lit("insert").alias("action"))
    refused = rows.where("geofence_id is null").select(F.lit(None).cast("long").alias("id"), "name", "mode", *fields, F.lit("refused").alias("action"))
    return known.unionByName(made).unionByName(refused).select("id", "geofence_id", "name", "mode", *columns, "action")


def fences_deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables geofence, geofence_project, geofence_property and route after a delete of fences (id).

    A fence that is the parent of one that stays is refused, and so are its own parents if it stays for that; what belongs to a
    deleted fence goes with it. geofence has the column refused.
    """
    fences = tables["geofence"]
    asked = ids.select(F.col("id").cast("long").alias("id")).distinct()
    gone = fences.select("id", "parent").join(asked, "id", "left_semi")
    staying = fences.join(gone.select("id"), "id", "left_anti").where("parent is not null").select(F.col("parent").alias("id")).distinct()
    # a parent has no parent itself in the catalog's two levels; deeper chains take a step each
    refused = gone.join(staying, "id", "left_semi").select("id")
    while True:
        more = gone.join(refused, "id", "left_semi").where("parent is not null").select(F.col("parent").alias("id")).distinct()
        more = more.join(gone.select("id"), "id", "left_semi").join(refused, "id", "left_anti")
        if more.isEmpty():
            break
        refused = refused.unionByName(more)
    gone = gone.join(refused, "id", "left_anti").select("id")
    out = {"geofence": fences.join(gone, "id", "left_anti").join(refused.withColumn("refused", F.lit(True)), "id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))}
    for t in ("geofence_project", "geofence_property", "route"):
        out[t] = tables[t].join(gone.select(F.col("id").alias("geofence_id")), "geofence_id", "left_anti")
    return out
