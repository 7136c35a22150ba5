"""Check requests from files of JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.requests import read_check_requests


def load_check_requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line -> typed rows with validation ``reasons``."""
    return read_check_requests(spark.read.text(path).withColumnRenamed("value", "json"))
