"""Extracted document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.retrieval import ingest


def read_documents(spark: SparkSession, path: str, language: str = "cs") -> DataFrame:
    """Text files, one document each -> ``source_document, language, text, page_number``."""
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("source_document"),
        F.lit(language).alias("language"), F.col("value").alias("text"),
    )
    return ingest(texts)
