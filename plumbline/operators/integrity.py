"""Declared constraints and defaults, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas


def apply_defaults(df: DataFrame, table: str, now: Column | None = None, update: bool = False) -> DataFrame:
    """Fills declared defaults; ``update`` refreshes ``updated_at``.  Columns the frame lacks
    are added."""
    now = (F.current_timestamp() if now is None else now).cast("timestamp_ntz")
    kinds = {f.name: f.dataType for f in schemas.table_schema(table).fields}
    filled = {}
    for column, value in schemas.DEFAULTS[table].items():
        default = now if value == "now" else F.lit(value).cast(kinds[column])
        filled[column] = F.coalesce(F.col(column), default) if column in df.columns else default
    if update and "updated_at" in filled:
        filled["updated_at"] = now
    return df.withColumns(filled)


def domain_check(violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` by severity domain and confidence range."""
    good = F.col("severity").isin(schemas.SEVERITIES) & F.col("confidence_score").between(0.0, 1.0)
    good = F.coalesce(good, F.lit(False))
    return violations.filter(good), violations.filter(~good)


def not_null_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, nulls`` for each declared non-null column; one pass per table."""
    parts = []
    for name, df in tables.items():
        columns = schemas.NOT_NULL[name]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]
        parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, parts)


def unique_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, key, copies`` for each duplicated value of a unique column."""
    parts = []
    for name, df in tables.items():
        for column in schemas.UNIQUE[name]:
            groups = df.filter(F.col(column).isNotNull()).groupBy(
                F.col(column).cast("string").alias("key")
            ).agg(F.count(F.lit(1)).alias("copies"))
            parts.append(groups.filter("copies > 1").select(
                F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "key", "copies"
            ))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, key, rows`` for foreign keys without a parent.

    Child keys are counted before the anti join, so a hot key is one row of it.
    """
    parts = []
    for child, column, parent in schemas.FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        keys = tables[child].filter(F.col(column).isNotNull()).groupBy(
            F.col(column).alias("key")
        ).agg(F.count(F.lit(1)).alias("rows"))
        parents = tables[parent].select(F.col("id").alias("key"))
        parts.append(keys.join(parents, "key", "left_anti").select(
            F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), F.col("key").cast("string").alias("key"), "rows"
        ))
    return reduce(DataFrame.unionByName, parts)


def health_rollup(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: ``healthy`` only when every integrity report is clean, with the three statuses."""
    faults = [
        ("not_null", not_null_report(tables).agg(F.sum("nulls").alias("faults"))),
        ("unique", unique_report(tables).agg(F.count(F.lit(1)).alias("faults"))),
        ("foreign_key", orphan_report(tables).agg(F.count(F.lit(1)).alias("faults"))),
    ]
    rows = reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("name"), F.coalesce("faults", F.lit(0)).alias("faults"))
        for name, df in faults
    ])
    status = F.when(F.col("faults") == 0, "healthy").otherwise("unhealthy")
    return rows.withColumn("state", status).agg(
        F.when(F.every(F.col("state") == "healthy"), "healthy").otherwise("degraded").alias("status"),
        *[F.max(F.when(F.col("name") == name, F.col("state"))).alias(f"{name}_status") for name, _ in faults],
    )
