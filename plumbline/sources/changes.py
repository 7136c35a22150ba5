"""Change feed of model elements as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The change record, raw element fields included.
CHANGE = (
    "element_id BIGINT, ts TIMESTAMP_NTZ, change_type STRING, category STRING, kind STRING, "
    "wall_width DOUBLE, wall_height DOUBLE, wall_function STRING, family_name STRING, "
    "params MAP<STRING,DOUBLE>, room_type STRING, occupancy INT, floor_level INT"
)


def read_change_feed(spark: SparkSession, path: str, schema: str | T.StructType = CHANGE,
                     format: str = "parquet", files_per_trigger: int | None = None,
                     glob: str | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """Streaming rows from new files below ``path``; ``files_per_trigger`` or ``bytes_per_trigger`` bounds a
    micro-batch.  A bounded batch only delays rows if files come in about the order of their times."""
    if files_per_trigger and bytes_per_trigger:
        raise ValueError("a micro-batch is bounded by files or by bytes, not by both")
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)
