"""Checked rows -> ``compliance_checks`` and ``check_results``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.enrich import with_rule_keys
from plumbline.session import cut_lineage
from plumbline.streaming.atomic import publish, read_published


# A stored id is batch times this, plus Spark's 63 bits of partition and row.
BATCH_IDS = 1 << 64


def numbered(df: DataFrame, batch_id: int) -> DataFrame:
    """Adds ``id`` (decimal, so that no number of batches, partitions or rows is too large), unique over all batches without
    asking what is stored; not dense."""
    base = F.lit(str(batch_id * BATCH_IDS)).cast("decimal(38,0)")
    return df.withColumn("id", (base + F.monotonically_increasing_id().cast("decimal(20,0)")).cast("decimal(38,0)"))


def check_rows(checked: DataFrame) -> DataFrame:
    """Checked rows in the shape of ``compliance_checks``, plus ``violations``."""
    stamp = F.regexp_replace("checked_at", "Z$", "").cast("timestamp_ntz")
    return checked.select(
        "id", "project_id", "element_id", "element_type", "properties", "context",
        F.col("compliant").alias("is_compliant"),
        F.size("violations").alias("violations_count"), stamp.alias("checked_at"), "violations",
    )


def result_rows(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Exploded violations of check rows with integer rule keys in ``rule_id``, null without a stored rule."""
    exploded = rows.select(
        F.col("id").alias("check_id"), F.col("checked_at").alias("created_at"), F.explode("violations").alias("v")
    ).select("check_id", "created_at", "v.*")
    return with_rule_keys(exploded, rules).select(
        "check_id", F.col("rule_key").alias("rule_id"), "severity", "message", "required_value",
        "actual_value", "confidence_score", "created_at", F.col("rule_id").alias("rule_text"),
    )


def persist(checked: DataFrame, rules: DataFrame, path: str, batch_id: int = 0, grain: str = "day") -> DataFrame:
    """Stores both tables of a batch below ``path`` and returns its violations without a stored rule.

    Both tables become visible together, once: a batch that failed midway is written anew, a batch that is stored
    is left alone (``read_stored``).  Rows without an ``id`` get one in a checkpoint that both tables are
    written from.  Checks are partitioned by ``check_date``, the day or the first day of the ``grain``;
    rebalancing gives even files per date, however skewed the dates are.
    """
    if "id" not in checked.columns:
        checked = cut_lineage(numbered(checked, batch_id))
    rows = check_rows(checked)
    results = result_rows(rows, rules)
    dated = rows.drop("violations").withColumn("check_date", F.to_date(F.date_trunc(grain, "checked_at")))
    stored = numbered(results.filter("rule_id IS NOT NULL").drop("rule_text"), batch_id)
    publish({
        "compliance_checks": dated.hint("rebalance", "check_date"),
        "check_results": stored.select("id", *[c for c in stored.columns if c != "id"]),
    }, batch_id, path, {"compliance_checks": "check_date"})
    return results.filter("rule_id IS NULL")


def read_stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of complete batches."""
    return read_published(spark, path, table)
