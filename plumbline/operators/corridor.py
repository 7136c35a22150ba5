"""The built-in corridor-width rule and the outcome of a check.

Everything here is a Column expression of the record itself: one narrow stage, no shuffle,
the same in batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.text import float_text, iso_stamp

# Fixed values of the built-in rule.
CORRIDOR_RULE = {
    "rule_id": "ČSN_73_0802_Sec_5.2.a",
    "standard": "ČSN 73 0802",
    "severity": "critical",
    "code_reference": "Section 5.2(a) - Escape Routes",
    "confidence_score": 0.98,
    "element_types": ["wall", "corridor"],
    "room_type": "Corridor",
    "min_width": 1200,
    "min_width_crowded": 1500,
    "crowd_limit": 200,
}


def rule_applies(element_type: Column, room_type: Column) -> Column:
    """Element type in any case, room type exactly; never null."""
    hit = F.lower(element_type).isin(CORRIDOR_RULE["element_types"]) & (
        room_type == CORRIDOR_RULE["room_type"]
    )
    return F.coalesce(hit, F.lit(False))


def required_width(occupancy: Column) -> Column:
    """Minimum width in whole millimetres; an unknown occupancy is not crowded."""
    crowded = occupancy > CORRIDOR_RULE["crowd_limit"]
    return F.when(crowded, CORRIDOR_RULE["min_width_crowded"]).otherwise(CORRIDOR_RULE["min_width"])


def violation(width: Column, required: Column) -> Column:
    message = F.concat(
        F.lit("Corridor width ("), float_text(width), F.lit("mm) is less than minimum "),
        required.cast("string"), F.lit(f"mm required by {CORRIDOR_RULE['standard']}"),
    )
    return F.struct(
        F.lit(CORRIDOR_RULE["rule_id"]).alias("rule_id"),
        F.lit(CORRIDOR_RULE["severity"]).alias("severity"),
        message.alias("message"),
        required.cast("double").alias("required_value"),
        width.cast("double").alias("actual_value"),
        F.lit(CORRIDOR_RULE["code_reference"]).alias("code_reference"),
        F.lit(CORRIDOR_RULE["confidence_score"]).alias("confidence_score"),
    )


def corridor_violations(element_type: Column, width: Column, context: Column) -> Column:
    """Array of no or one violation.  Spark orders NaN above numbers, so NaN never violates."""
    required = required_width(context["occupancy"])
    broken = rule_applies(element_type, context["room_type"]) & (width < required)
    kind = f"array<struct<{_ddl_fields()}>>"
    return F.when(F.coalesce(broken, F.lit(False)), F.array(violation(width, required))).otherwise(
        F.array().cast(kind)
    )


def _ddl_fields() -> str:
    fields = schemas.struct(schemas.VIOLATION).fields
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)


def with_outcome(df: DataFrame, checked_at: Column | None = None) -> DataFrame:
    """Adds ``compliant``, ``recommendations`` and ``checked_at`` beside ``violations``."""
    broken = F.size("violations") > 0
    advice = F.concat(
        F.lit("Increase "), F.lower("element_type"), F.lit(" spacing to meet minimum requirements")
    )
    return df.withColumns({
        "compliant": ~broken,
        "recommendations": F.when(broken, F.array(advice)).otherwise(F.array().cast("array<string>")),
        "checked_at": iso_stamp(F.current_timestamp() if checked_at is None else checked_at),
    })


def check_corridor(df: DataFrame, checked_at: Column | None = None) -> DataFrame:
    """Checks records with ``element_type, properties, context`` against the built-in rule.

    ``checked_at`` fixes the stamp (a column of the input, say) so that results repeat.
    """
    found = corridor_violations(F.col("element_type"), F.col("properties.width_mm"), F.col("context"))
    return with_outcome(df.withColumn("violations", found), checked_at)


def explode_violations(checked: DataFrame, *keys: str) -> DataFrame:
    """One row per violation with the given key columns."""
    return checked.select(*keys, F.explode("violations").alias("v")).select(*keys, "v.*")


def violation_alerts(checked: DataFrame, *keys: str) -> DataFrame:
    """Alert rows: non-compliant results only, one per violation."""
    return explode_violations(checked.filter(~F.col("compliant")), *(keys or ("element_id",)))
