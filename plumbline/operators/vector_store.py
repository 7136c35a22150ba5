"""Stored vectors with upsert: hash buckets of chunk ids, copied on write.

A chunk id belongs to one of ``buckets`` buckets by its hash.  An upsert reads and rewrites only the buckets its rows fall into, as
folders of an attempt of its own, and publishes them by one commit; the other buckets' files are left alone and readers see all of a batch or
nothing.  The newest published folder of each bucket is the table, so what is sent to the driver to read it is one path a bucket.
A batch that is published before is skipped, so a replay is harmless; batches must come in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.retrieval import upsert_vectors
from plumbline.streaming.atomic import commits, exists, is_committed, publish

BUCKETS = 256


def bucket_of(buckets: int, chunk_id: str = "chunk_id") -> Column:
    return F.pmod(F.xxhash64(F.col(chunk_id)), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, path: str, buckets: int | None = None) -> dict[int, str]:
    """The newest published folder of each bucket that has one."""
    if not exists(spark, f"{path}/commits"):
        return {}
    touched = spark.read.option("basePath", f"{path}/touched").parquet(f"{path}/touched/*").withColumn("attempt", F.col("attempt").cast("string"))
    newest = touched.join(commits(spark, path), "attempt").groupBy("bucket").agg(F.max_by("attempt", "batch_id").alias("attempt"), F.max("buckets").alias("buckets"))
    found = newest.collect()  # one row a bucket
    if buckets is not None and {r.buckets for r in found} - {buckets}:
        raise ValueError(f"{path} is stored in {found[0].buckets} buckets, not {buckets}")
    return {r.bucket: r.attempt for r in found}


def _read(spark: SparkSession, path: str, folders: dict[int, str]) -> DataFrame:
    paths = [f"{path}/vectors/attempt={attempt}/bucket={bucket}" for bucket, attempt in sorted(folders.items())]
    return spark.read.option("basePath", f"{path}/vectors").parquet(*paths).drop("attempt")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is published; ``bucket`` tells a row's bucket."""
    folders = _current(spark, path)
    if not folders:
        raise ValueError(f"no published vectors in {path}")
    return _read(spark, path, folders)


def upsert(new: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS) -> bool:
    """Puts rows in place of those with the same ``chunk_id``; False for a batch published before.

    Of rows that repeat an id in one batch the greatest counts; a null id is no id.
    """
    spark = new.sparkSession
    if is_committed(spark, batch_id, path):
        return False
    others = [c for c in new.columns if c not in ("chunk_id", "bucket")]
    rows = new.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct(*others)).alias("_row")).select("chunk_id", "_row.*")
    rows = rows.withColumn("bucket", bucket_of(buckets))
    hit = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
    held = {b: a for b, a in _current(spark, path, buckets).items() if b in set(hit)}
    merged = upsert_vectors(_read(spark, path, held).select(*rows.columns), rows) if held else rows
    touched = spark.createDataFrame([(b, buckets) for b in hit], "bucket int, buckets int")
    return publish({"vectors": merged.repartition("bucket"), "touched": touched.coalesce(1)}, batch_id, path, {"vectors": "bucket"})
