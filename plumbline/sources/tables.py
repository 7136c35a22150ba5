"""The five relational tables and their JSON columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas


def load_table(spark: SparkSession, name: str, path: str | None = None, format: str = "parquet",
               **options) -> DataFrame:
    """A table with its declared schema; columns the source lacks are null.

    ``format="jdbc"`` takes ``url`` and, for a parallel read, ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions``.  JSON columns kept as text there are
    decoded to the declared types.
    """
    schema = schemas.table_schema(name)
    if format == "jdbc":
        return decode_json(spark.read.format("jdbc").options(dbtable=name, **options).load(), name)
    return spark.read.format(format).options(**options).schema(schema).load(path)


def write_table(df: DataFrame, name: str, path: str, mode: str = "append", **options) -> None:
    """Writes the declared columns, cast to the declared types."""
    columns = [F.col(f.name).cast(f.dataType) for f in schemas.table_schema(name).fields]
    df.select(*columns).write.mode(mode).options(**options).parquet(path)


def json_columns(name: str) -> dict[str, T.DataType]:
    """Columns the database keeps as JSON, with their types here."""
    fields = schemas.table_schema(name).fields
    return {f.name: f.dataType for f in fields if isinstance(f.dataType, (T.ArrayType, T.StructType))}


def decode_json(df: DataFrame, name: str) -> DataFrame:
    """JSON text columns -> arrays and structs."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    kinds = {c: k for c, k in json_columns(name).items() if c in text}
    return df.withColumns({c: F.from_json(F.col(c), k.simpleString()) for c, k in kinds.items()})


def encode_json(df: DataFrame, name: str) -> DataFrame:
    """Arrays and structs -> JSON text columns."""
    kept = [c for c in json_columns(name) if c in df.columns]
    return df.withColumns({c: F.to_json(F.col(c), {"ignoreNullFields": "false"}) for c in kept})
