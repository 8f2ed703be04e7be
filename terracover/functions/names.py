"""The name modifier: sixteen string operations in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED, PLAIN = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"


def _first_upper(x: Column) -> Column:
    return F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))


def modify(
    name: Column, parent: Column | None = None, *, trimstart: int = 0, trimend: int = 0, alphanumeric: bool = False, replace: str | None = None, parentreplace: str | None = None,
    parentstart: str | None = None, parentend: str | None = None, lowercase: bool | None = None, uppercase: bool | None = None, capfirst: bool | None = None, capitalize: str | None = None,
    underscore: str | None = None, dash: str | None = None, space: str | None = None, unpolish: bool | None = None,
) -> Column:
    """The modified name; the given one where nothing would be left.

    Flags count by presence: lowercase=False lowers too. trim counts are characters.
    parentreplace puts its text in place of the first occurrence of the parent's name.
    """
    up = F.coalesce(parent, F.lit("")) if parent is not None else F.lit("")
    x = name
    if trimstart:
        x = F.substr(x, F.lit(trimstart + 1))
    if trimend:
        x = F.substr(x, F.lit(1), F.greatest(F.length(x) - trimend, F.lit(0)))
    if alphanumeric:
        x = F.regexp_replace(x, r"[^\p{L}\p{N}\s]", "")
    if replace is not None:
        x = F.replace(x, F.lit(replace), F.lit(""))
    if parentreplace is not None:
        at = F.instr(x, up)
        x = F.when((F.length(up) > 0) & (at > 0), F.concat(F.substr(x, F.lit(1), at - 1), F.lit(parentreplace), F.substr(x, at + F.length(up)))).otherwise(x)
    if parentstart is not None:
        x = F.when(F.length(up) > 0, F.concat(up, F.lit(parentstart), x)).otherwise(x)
    if parentend is not None:
        x = F.when(F.length(up) > 0, F.concat(x, F.lit(parentend), up)).otherwise(x)
    if lowercase is not None:
        x = F.lower(x)
    if uppercase is not None:
        x = F.upper(x)
    if capfirst is not None:
        x = _first_upper(x)
    if capitalize is not None:
        sep = capitalize
        x = F.array_join(F.transform(F.split(x, "\\Q" + sep + "\\E"), _first_upper), sep)
    if underscore is not None:
        x = F.replace(x, F.lit("_"), F.lit(underscore))
    if dash is not None:
        x = F.replace(x, F.lit("-"), F.lit(dash))
    if space is not None:
        x = F.replace(x, F.lit(" "), F.lit(space))
    if unpolish is not None:
        x = F.translate(x, ACCENTED, PLAIN)
    x = F.trim(x)
    return F.coalesce(F.nullif(x, F.lit("")), name)
