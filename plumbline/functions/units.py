"""Unit conversion as Column arithmetic: models are in feet, codes in metric units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MM_PER_FOOT = 304.8
SQM_PER_SQFT = 0.092903


def feet_to_mm(feet: Column) -> Column:
    return feet.cast("double") * F.lit(MM_PER_FOOT)


def mm_to_feet(mm: Column) -> Column:
    return mm.cast("double") / F.lit(MM_PER_FOOT)


def sqft_to_sqm(sqft: Column) -> Column:
    return sqft.cast("double") * F.lit(SQM_PER_SQFT)
