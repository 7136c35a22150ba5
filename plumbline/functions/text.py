"""Text and parsing functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(value: Column) -> Column:
    """A double the way the check service prints it: ``200.0``, ``10000000.0``, ``1e-05``.

    Spark's own cast turns to ``1.0E7`` notation outside [1e-3, 1e7); the service
    only does so outside [1e-4, 1e16).
    """
    value = value.cast("double")
    plain = value.cast("string")
    size = F.abs(value)
    # decimal text without its trailing zeros, but with one digit after the point
    fixed = F.regexp_replace(value.try_cast("decimal(38,21)").cast("string"), r"(\.\d*?[1-9]|\.0)0+$", "$1")
    return (
        F.when((size >= 1e-3) & (size < 1e7), plain)
        .when((size >= 1e-4) & (size < 1e16), fixed)
        .otherwise(_scientific(plain))
    )


def _scientific(plain: Column) -> Column:
    """``1.0E-5`` -> ``1e-05``, ``1.5E16`` -> ``1.5e+16``, ``Infinity`` -> ``inf``."""
    text = F.regexp_replace(plain, r"(\.0)?E-(\d)$", "e-0$2")
    text = F.regexp_replace(text, r"(\.0)?E-", "e-")
    text = F.regexp_replace(text, r"(\.0)?E", "e+")
    text = F.replace(text, F.lit("Infinity"), F.lit("inf"))
    return F.replace(text, F.lit("NaN"), F.lit("nan"))


def floor_number(level_name: Column, has_level_param: Column) -> Column:
    """Floor number read off a level name.

    No level parameter gives null and a missing level gives 0.  A name that is a
    whole number is that number; otherwise digits or words for the first two floors count.
    """
    whole = F.regexp_extract(level_name, r"^\s*([+-]?[0-9]+)\s*$", 1)
    parsed = F.when(whole != "", whole).try_cast("int")
    lowered = F.lower(level_name)
    first = level_name.contains("1") | lowered.contains("first") | lowered.contains("ground")
    second = level_name.contains("2") | lowered.contains("second")
    number = F.coalesce(parsed, F.when(first, 1).when(second, 2).otherwise(0))
    return F.when(F.coalesce(has_level_param, F.lit(False)), number)


def first_param(params: Column, *names: str) -> Column:
    """First non-null of the named parameters of a ``map<string,double>``."""
    return F.coalesce(*[F.try_element_at(params, F.lit(name)) for name in names])


# Display names that stand for one element type.
SINGULAR = {
    "walls": "wall",
    "doors": "door",
    "windows": "window",
    "floors": "floor",
    "rooms": "room",
    "corridors": "corridor",
    "stair": "stairs",
}


def element_type(category: Column, normalise: bool = False) -> Column:
    """Category name or ``Unknown``; ``normalise`` also folds case and plurals."""
    name = F.coalesce(category, F.lit("Unknown"))
    if not normalise:
        return name
    folded = F.lower(F.trim(name))
    chain = F.when(F.lit(False), folded)
    for plural, singular in SINGULAR.items():
        chain = chain.when(folded == plural, singular)
    return chain.otherwise(folded)


def iso_stamp(ts: Column) -> Column:
    """ISO-8601 UTC text with ``Z``; the fraction is left out when it is zero."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("Z"))


def distinct_tokens(text: Column) -> Column:
    """Distinct lower-case letter/digit runs."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))
