"""Typed properties: casting a stored text by its category, and inferring a category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories, mode aliases, acronyms and defaults by geometry.
CATEGORIES = ("boolean", "string", "number", "object", "array", "database", "color")
MODES = ("circle_pokemon", "circle_smart_pokemon", "circle_raid", "circle_smart_raid", "auto_quest", "circle_quest", "circle_station", "pokemon_iv", "leveling", "auto_pokemon", "auto_tth", "unset")
AREA_MODES = ("auto_quest", "pokemon_iv", "auto_pokemon", "auto_tth")
ACRONYMS = {"auto_quest": "AQ", "circle_pokemon": "CP", "circle_smart_pokemon": "CSP", "circle_raid": "CR", "circle_smart_raid": "CSR", "circle_quest": "CQ", "pokemon_iv": "IV", "auto_pokemon": "AP", "auto_tth": "ATTH", "leveling": "L"}
LEGACY_MODES = {"AutoQuest": "auto_quest", "PokemonIv": "pokemon_iv", "CirclePokemon": "circle_pokemon", "CircleRaid": "circle_raid", "ManualQuest": "circle_quest"}


def cast_text(value: Column, category: Column) -> Column:
    """The JSON text of a stored value: bad numbers are 0, bad booleans false, database values null."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return (
        F.when(category.isin("string", "color"), F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6))
        .when(category == "number", number.cast("string"))
        .when(category == "boolean", F.when(F.lower(value) == "true", F.lit("true")).otherwise(F.lit("false")))
        .when(category.isin("object", "array"), value)
    )


def infer(value: Column) -> Column:
    """The category that a raw JSON value would get."""
    text = F.trim(value)
    return (
        F.when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.try_cast("double").isNotNull(), "number")
        .when(text.startswith("["), "array")
        .when(text.startswith("{"), "object")
        .when(text.rlike(r"^(#|rgb)"), "color")
        .otherwise("string")
    )


def mapped(column: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A lookup in a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default if default is not None else F.lit(None))


def default_mode(geo_type: Column) -> Column:
    return F.when(geo_type == "Point", "leveling").when(geo_type == "MultiPoint", "circle_pokemon").when(geo_type.isin("Polygon", "MultiPolygon"), "auto_quest").otherwise("unset")
