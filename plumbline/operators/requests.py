"""Check requests: JSON text -> validated, typed rows; checked rows -> JSON text.

Validation is one narrow pass and one parse a text.  Leaves are read as text and cast one by one, so that a bad
leaf gets a reason instead of silently becoming null.  Of a key that is given twice the last one counts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas

# Texts accepted for numeric fields.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SPECIAL_TEXT = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"
WHOLE_TEXT = r"^\s*[+-]?[0-9]+(\.0+)?\s*$"

# Numbers of the service's JSON that the standard lacks, where a value can stand.
SPECIAL_NUMBER = r"([:\[,]\s*)(-?Infinity|NaN)\b"

# Leaf texts whose meaning depends on the JSON type they had.
_DOUBTFUL = {
    "text": r"^(-?[0-9]|true$|false$|[\[{])",
    "number": r"^(true|false)$",
    "whole": r"[^0-9+-]",
}

_PROPERTY_FIELDS = [
    ("width_mm", "number", True),
    ("height_mm", "number", False),
    ("length_mm", "number", False),
    ("function", "text", False),
]
_CONTEXT_FIELDS = [
    ("room_type", "text", False),
    ("building_type", "text", False),
    ("occupancy", "whole", False),
    ("floor_level", "whole", False),
]


def _kind(leaf: Column) -> Column:
    """Kind of a JSON value: text, number, flag, object, array; null for null and absent."""
    name = F.schema_of_variant(leaf)
    return (
        F.when(name.isin("BIGINT", "DOUBLE") | name.startswith("DECIMAL"), "number")
        .when(name == "STRING", "text")
        .when(name == "BOOLEAN", "flag")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
    )


def _from_text(kind: Column, text: Column) -> Column:
    return F.when(kind == "text", text)


def _from_number(kind: Column, text: Column) -> Column:
    flag = F.when(text == "true", 1.0).otherwise(0.0)
    written = text.rlike(NUMBER_TEXT) | text.rlike(SPECIAL_TEXT)
    return F.when(kind == "flag", flag).when(written, F.trim(text).try_cast("double"))


def _from_whole(kind: Column, text: Column) -> Column:
    flag = F.when(text == "true", 1).otherwise(0)
    number = F.trim(text).try_cast("double")
    good = F.when(kind == "text", text.rlike(WHOLE_TEXT)).otherwise(number == F.floor(number))
    return F.when(kind == "flag", flag).when(good, number.try_cast("int"))


# Parser, and the kind of a leaf whose text leaves no doubt.
_PARSERS = {
    "text": (_from_text, "text"), "number": (_from_number, "number"), "whole": (_from_whole, "number"),
}


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns by a row-wise generator, which the optimizer neither copies into the places
    that use them nor pushes filters through: each text is parsed once."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def read_check_requests(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds ``element_type, properties, context`` and ``reasons`` (empty when valid)."""
    fields = [("element_type", "element_type", "text", True)]
    fields += [(f"properties.{n}", f"p_{n}", t, r) for n, t, r in _PROPERTY_FIELDS]
    fields += [(f"context.{n}", f"c_{n}", t, r) for n, t, r in _CONTEXT_FIELDS]

    # One parse a text; a leaf is read as text, and its kind only where the text leaves a doubt.
    given = F.when(F.col(json).contains("NaN") | F.col(json).contains("Infinity"), F.regexp_replace(json, SPECIAL_NUMBER, '$1"$2"')).otherwise(F.col(json))
    out = _once(df, {"_v": F.try_parse_json(given)})
    out = _once(out, {f"_t_{name}": F.try_variant_get("_v", f"$.{path}", "string") for path, name, _, _ in fields})
    text = {name: F.col(f"_t_{name}") for _, name, _, _ in fields}

    def kind_at(path: str) -> Column:
        return _kind(F.variant_get("_v", path, "variant"))

    def holds(prefix: str, members: list) -> Column:
        return reduce(or_, [text[f"{prefix}_{n}"].isNotNull() for n, _, _ in members])

    kinds = {f"_k_{name}": F.when(text[name].rlike(_DOUBTFUL[t]), kind_at(f"$.{path}")).otherwise(_PARSERS[t][1]) for path, name, t, _ in fields}
    filled = {"properties": holds("p", _PROPERTY_FIELDS), "context": holds("c", _CONTEXT_FIELDS)}
    kinds |= {f"_k_{part}": F.when(some, "object").otherwise(kind_at(f"$.{part}")) for part, some in filled.items()}
    kinds["_k_root"] = F.when(reduce(or_, [*filled.values(), text["element_type"].isNotNull()]), "object").otherwise(_kind(F.col("_v")))
    out = _once(_once(out, kinds).drop("_v"), {
        f"_v_{name}": F.when(text[name].isNotNull(), _PARSERS[t][0](F.col(f"_k_{name}"), text[name]))
        for path, name, t, _ in fields
    })

    is_object = F.coalesce(F.col("_k_root") == "object", F.lit(False))
    has_properties = is_object & F.coalesce(F.col("_k_properties") == "object", F.lit(False))
    has_context = is_object & F.coalesce(F.col("_k_context") == "object", F.lit(False))

    def reason(fault: Column, label: str) -> Column:
        return F.when(F.coalesce(fault, F.lit(False)), F.lit(label))

    reasons = [
        reason(F.coalesce(~is_object, F.lit(True)), "json.invalid"),
        reason(is_object & F.col("_k_properties").isNull(), "properties.missing"),
        reason(is_object & (F.col("_k_properties") != "object"), "properties.type"),
        reason(is_object & (F.col("_k_context") != "object"), "context.type"),
    ]
    for path, name, _, required in fields:
        inside = {"p": has_properties, "c": has_context}.get(name[:2].rstrip("_"), is_object)
        if required:
            reasons.append(reason(inside & text[name].isNull(), f"{path}.missing"))
        reasons.append(reason(inside & text[name].isNotNull() & F.col(f"_v_{name}").isNull(), f"{path}.type"))

    def record(prefix: str, members: list, present: Column) -> Column:
        value = F.struct(*[F.col(f"_v_{prefix}_{n}").alias(n) for n, _, _ in members])
        return F.when(present, value)

    return out.select(
        *df.columns,
        F.col("_v_element_type").alias("element_type"),
        record("p", _PROPERTY_FIELDS, has_properties)
        .cast(schemas.struct(schemas.PROPERTIES)).alias("properties"),
        record("c", _CONTEXT_FIELDS, has_context)
        .cast(schemas.struct(schemas.CONTEXT)).alias("context"),
        F.array_compact(F.array(*reasons)).alias("_reasons"),
    ).select(*df.columns, "element_type", "properties", "context", F.explode(F.array("_reasons")).alias("reasons"))


def validate(df: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Splits JSON rows into ``(valid, rejected)``; every input row is in exactly one.

    Each part reads the source when written; a job that stores both in one pass writes
    ``read_check_requests`` partitioned by whether ``reasons`` is empty.
    """
    parsed = read_check_requests(df, json)
    return (
        parsed.filter(F.size("reasons") == 0).drop("reasons", json),
        parsed.filter(F.size("reasons") > 0).select(*df.columns, "reasons"),
    )


def apply_error_policy(df: DataFrame, policy: str = "isolate", json: str = "json") -> tuple:
    """``isolate`` quarantines bad rows; ``fail`` aborts the job at the first bad row."""
    if policy == "isolate":
        return validate(df, json)
    if policy != "fail":
        raise ValueError(f"unknown error policy: {policy}")
    parsed = read_check_requests(df, json)
    message = F.concat(F.lit("rejected request: "), F.array_join("reasons", ","))
    # as a filter the guard stays, whichever columns are read
    guard = F.when(F.size("reasons") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return parsed.filter(guard).drop("reasons", json), None


def to_response_json(df: DataFrame) -> DataFrame:
    """Adds ``json``: the response record of a checked row."""
    response = F.struct("compliant", "violations", "recommendations", "checked_at")
    return df.withColumn("json", F.to_json(response, {"ignoreNullFields": "false"}))


def write_check_responses(df: DataFrame, path: str, mode: str = "append") -> None:
    """Response records as JSON lines."""
    df.select("compliant", "violations", "recommendations", "checked_at").write.mode(mode).option(
        "ignoreNullFields", "false"
    ).json(path)
