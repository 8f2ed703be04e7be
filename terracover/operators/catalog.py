"""The catalog: fences, projects, routes and typed properties; upserts give the new table and an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracover.functions import props
from terracover.operators.grouping import numbered


def id_or_name(key: str) -> Column:
    """Match by id if the key is a number, else by name."""
    return F.col("id") == int(key) if key.isdecimal() else F.col("name") == key


def paginate(rows: DataFrame, sort: str, descending: bool, page: int, per_page: int) -> DataFrame:
    """A page with total, pages, has_next and has_prev; an unknown column sorts by name, ties by id."""
    sort = sort if sort in rows.columns else "name"
    order = F.desc(sort) if descending else F.asc(sort)
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(order, "id").offset(page * per_page).limit(per_page)
    pages = F.ceil(F.col("total") / per_page)
    return part.crossJoin(F.broadcast(total)).select(*part.columns, "total", pages.alias("pages"), (page + 1 < pages).alias("has_next"), (pages == page + 1).alias("has_prev"))


def geofence_filter(fences: DataFrame, bridge: DataFrame, parent: int | None = None, geo_type: str | None = None, mode: str | None = None, project: int | None = None) -> DataFrame:
    """The admin list's filters; parent 0: without parent, project 0: in no project."""
    if parent is not None:
        fences = fences.where(F.col("parent").isNull() if parent == 0 else F.col("parent") == parent)
    if geo_type:
        fences = fences.where(F.col("geo_type") == geo_type)
    if mode:
        fences = fences.where(F.col("mode") == mode)
    if project is not None:
        own = bridge if project == 0 else bridge.where(F.col("project_id") == project)
        fences = fences.join(own.select(F.col("geofence_id").alias("id")), "id", "left_anti" if project == 0 else "left_semi")
    return fences


def points_range(low: int | None, high: int | None) -> Column:
    """Both: inclusive; one alone: strict."""
    p = F.col("points")
    if low is not None and high is not None:
        return p.between(low, high)
    return p > low if low is not None else p < high if high is not None else F.lit(True)


def of_project(fences: DataFrame, bridge: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    own = projects.where(id_or_name(key)).select(F.col("id").alias("project_id"))
    return fences.join(bridge.join(own, "project_id", "left_semi").select(F.col("geofence_id").alias("id")), "id", "left_semi")


def property_values(values: DataFrame, properties: DataFrame, fences: DataFrame) -> DataFrame:
    """(geofence_id, name, category, value): value or default; database properties read the fence's own column."""
    p = properties.select(F.col("id").alias("property_id"), F.col("name").alias("prop"), "category", "default_value")
    own = fences.select(F.col("id").alias("geofence_id"), F.col("name").alias("f_name"), F.col("mode").alias("f_mode"), F.col("geo_type").alias("f_type"), F.col("parent").alias("f_parent"))
    column = F.when(F.col("prop") == "name", F.col("f_name")).when(F.col("prop") == "mode", F.col("f_mode")).when(F.col("prop") == "geo_type", F.col("f_type")).when(F.col("prop") == "parent", F.col("f_parent").cast("string"))
    raw = F.when(F.col("category") == "database", column).otherwise(F.coalesce("value", "default_value"))
    return values.join(p, "property_id").join(own, "geofence_id").select("geofence_id", F.col("prop").alias("name"), "category", raw.alias("value"))


def property_maps(values: DataFrame) -> DataFrame:
    """(geofence_id, properties): one map per fence."""
    return values.groupBy("geofence_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("properties"))


def parent_names(fences: DataFrame, values: DataFrame) -> DataFrame:
    """(id, parent_name): a manual `parent` property, else the parent's `name` property, else the parent's name."""
    named = values.where("name = 'name'").select(F.col("geofence_id").alias("parent"), F.col("value").alias("by_property"))
    manual = values.where("name = 'parent'").select(F.col("geofence_id").alias("id"), F.col("value").alias("manual"))
    up = fences.select(F.col("id").alias("parent"), F.col("name").alias("by_name"))
    return fences.select("id", "parent").join(up, "parent", "left").join(named, "parent", "left").join(manual, "id", "left").select("id", F.coalesce("manual", "by_property", "by_name").alias("parent_name"))


def excluded(fences: DataFrame, names: str = "", parents: str = "") -> DataFrame:
    """Without the fences of given names, or of parents of given names (comma-separated, untrimmed)."""
    up = fences.select(F.col("id").alias("parent"), F.col("name").alias("__up"))
    out = fences.join(up, "parent", "left")
    if names:
        out = out.where(~F.col("name").isin(names.split(",")))
    if parents:
        out = out.where(F.col("__up").isNull() | ~F.col("__up").isin(parents.split(",")))
    return out.select(fences.columns)


def features(fences: DataFrame, values: DataFrame, internal: bool) -> DataFrame:
    """(id, properties) with the flags' entries; later entries win."""
    base = F.create_map(F.lit("__id" if internal else "id"), F.col("id").cast("string"), F.lit("__name" if internal else "name"), F.col("name"), F.lit("__mode" if internal else "mode"), F.col("mode"))
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    both = fences.join(property_maps(values).withColumnRenamed("geofence_id", "id"), "id", "left")
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(F.coalesce("properties", none), k)), F.coalesce("properties", none))
    return both.select("id", merged.alias("properties"))


def strip_internal(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, _: ~k.startswith("__"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The new table: key, columns and action (insert, update or keep). New rows win where they have a value."""
    a = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in columns), F.lit(True).alias("was"))
    b = new.select(*key, *(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("comes"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("comes").isNotNull(), "update").otherwise("keep")
    return a.join(b, key, "full").select(*key, *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in columns), action.alias("action"))


def set_sync(bridge: DataFrame, incoming: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member, action): what makes each incoming key's set equal; keys that do not come in stay."""
    mine = bridge.join(incoming.select(key).distinct(), key, "left_semi").select(key, member)
    want = incoming.where(F.col(member).isNotNull()).select(key, member).distinct()
    gone = mine.join(want, [key, member], "left_anti").withColumn("action", F.lit("delete"))
    return want.join(mine, [key, member], "left_anti").withColumn("action", F.lit("insert")).unionByName(gone)


def property_sync(current: DataFrame, incoming: DataFrame, properties: DataFrame) -> DataFrame:
    """(geofence_id, property_id, value) after a sync: mentioned ones only, null to default, database to null."""
    p = properties.select(F.col("id").alias("property_id"), "category", "default_value")
    value = F.when(F.col("category") == "database", F.lit(None)).otherwise(F.coalesce("value", "default_value"))
    fresh = incoming.join(p, "property_id").select("geofence_id", "property_id", value.alias("value"))
    return current.join(incoming.select("geofence_id").distinct(), "geofence_id", "left_anti").select("geofence_id", "property_id", "value").unionByName(fresh)


def recast(values: DataFrame, properties: DataFrame, property_id: int) -> DataFrame:
    """Values of a property whose category has changed go back to its default."""
    p = properties.where(F.col("id") == property_id).select(F.col("id").alias("property_id"), "default_value")
    return values.join(F.broadcast(p), "property_id", "left").select("geofence_id", "property_id", F.when(F.col("property_id") == property_id, F.col("default_value")).otherwise(F.col("value")).alias("value"))


def assign_parent(fences: DataFrame, child: int, parent: int) -> DataFrame:
    return fences.withColumn("parent", F.when(F.col("id") == child, F.lit(parent or None).cast("long")).otherwise(F.col("parent")))


def deleted(table: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows that a delete of ids, cascading over key, leaves."""
    return table.where(~F.col(key).isin(ids))


def validated(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows with an error column: the first required field that is missing; empty texts are null."""
    clean = rows.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    missing = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in required), F.lit(None).cast("string"))
    return clean.withColumn("error", missing)


def property_backfill(docs: DataFrame) -> DataFrame:
    """(name, category, n): properties of JSON features, exploded and with inferred categories."""
    entries = F.explode(F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>"))
    return docs.select(entries.alias("name", "value")).groupBy("name", props.infer(F.col("value")).alias("category")).agg(F.count("*").alias("n"))


def related(rows: DataFrame, bridge: DataFrame, left: str, right: str) -> DataFrame:
    """(id, related): the sorted ids on a bridge's other side; empty where there are none."""
    lists = bridge.groupBy(F.col(left).alias("id")).agg(F.sort_array(F.collect_list(F.col(right).cast("long"))).alias("related"))
    return rows.select("id").join(lists, "id", "left").select("id", F.coalesce("related", F.expr("cast(array() as array<bigint>)")).alias("related"))


def enumerated(points: DataFrame, prefix: Column, order: str) -> DataFrame:
    """(i, lat, lon): compact ids, the prefix and the row number from 0."""
    return numbered(points, order, "__i").select(F.concat(prefix, F.col("__i").cast("string")).alias("i"), "lat", "lon")
