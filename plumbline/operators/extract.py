"""Raw model elements -> check records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.text import element_type, first_param
from plumbline.functions.units import feet_to_mm

# Categories in singular and plural display form.
RELEVANT_CATEGORIES = [
    "Wall", "Door", "Window", "Floor", "Room", "Stairs",
    "Walls", "Doors", "Windows", "Floors", "Rooms", "Stair",
]
TRIGGER_CATEGORIES = ["Wall", "Door", "Walls", "Doors"]
WIDTH_NAMES = ("Width", "Šířka")
HEIGHT_NAMES = ("Height", "Výška")
DEFAULT_BUILDING_TYPE = "Residential"


def relevant(df: DataFrame, category: str = "category") -> DataFrame:
    """Elements of a checked category; a null category is dropped."""
    return df.filter(F.col(category).isin(RELEVANT_CATEGORIES))


def triggered(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Modified walls and doors; nothing while real-time checking is off."""
    if not enabled:
        return df.filter(F.lit(False))
    return df.filter(
        (F.col("change_type") == "modified") & F.col("category").isin(TRIGGER_CATEGORIES)
    )


def properties_of(kind: Column, df_cols: dict[str, Column] | None = None) -> Column:
    """Property record by element kind: walls from their own fields, family instances from
    named parameters, everything else empty."""
    col = {n: F.col(n) for n in ("wall_width", "wall_height", "wall_function", "family_name", "params")}
    col |= df_cols or {}
    wall, family = kind == "wall", kind == "family"
    return F.struct(
        F.when(wall, feet_to_mm(col["wall_width"]))
        .when(family, feet_to_mm(first_param(col["params"], *WIDTH_NAMES))).alias("width_mm"),
        F.when(wall, feet_to_mm(col["wall_height"]))
        .when(family, feet_to_mm(first_param(col["params"], *HEIGHT_NAMES))).alias("height_mm"),
        F.lit(None).cast("double").alias("length_mm"),
        F.when(wall, col["wall_function"]).when(family, col["family_name"]).alias("function"),
    ).cast(schemas.struct(schemas.PROPERTIES))


def extract_properties(df: DataFrame) -> DataFrame:
    """Adds ``element_type`` and ``properties``."""
    return df.withColumns({
        "element_type": element_type(F.col("category")),
        "properties": properties_of(F.col("kind")),
    })


def with_context(df: DataFrame, room_type: Column, floor_level: Column,
                 building_type: Column | None = None, occupancy: Column | None = None) -> DataFrame:
    """Adds the ``context`` record; the building type falls back to the fixed default."""
    default = F.lit(DEFAULT_BUILDING_TYPE)
    return df.withColumn("context", F.struct(
        room_type.alias("room_type"),
        (default if building_type is None else F.coalesce(building_type, default)).alias("building_type"),
        (F.lit(None) if occupancy is None else occupancy).cast("int").alias("occupancy"),
        floor_level.cast("int").alias("floor_level"),
    ))
