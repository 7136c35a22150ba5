"""All-or-nothing output: a batch is visible only once it is complete, and only once.

A batch writes its tables to folders of an attempt of its own and then commits one row that names the
attempt.  A batch that is committed already is skipped, a retry never touches what is committed, and readers take
committed attempts only; leftovers of broken attempts stay unseen.

A commit is a small file, complete before it gets its name, by a rename that refuses to replace: of several writers of one batch
exactly one wins, where the file system renames in one step (HDFS does; most object stores need a committer of their own).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def is_committed(spark: SparkSession, batch_id: int, path: str) -> bool:
    return exists(spark, f"{path}/commits/batch-{batch_id}.json")


def commit(spark: SparkSession, batch_id: int, attempt: str, path: str) -> bool:
    """Names the attempt that counts for a batch; False if another one does already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    draft, final = hadoop.Path(f"{path}/commits/_{attempt}"), hadoop.Path(f"{path}/commits/batch-{batch_id}.json")
    out = draft.getFileSystem(conf).create(draft, False)
    out.write(bytearray(json.dumps({"batch_id": batch_id, "attempt": attempt}).encode()))
    out.close()
    files = hadoop.FileContext.getFileContext(final.toUri(), conf)
    try:
        files.rename(draft, final, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError:
        if is_committed(spark, batch_id, path):
            return False
        raise
    return True


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, attempt`` of what is published."""
    return spark.read.schema("batch_id BIGINT, attempt STRING").json(f"{path}/commits")


def publish(tables: dict[str, DataFrame], batch_id: int, path: str, partition_by: dict[str, str] | None = None,
            approve: Callable[[], None] | None = None) -> bool:
    """Writes all tables of a batch and commits them together; False for a batch that is committed by another attempt.

    ``approve`` is called when all is written and may raise, which leaves the batch unpublished.
    """
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, batch_id, path):
        return False
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        writer = df.write.mode("error")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{path}/{name}/attempt={attempt}")
    if approve:
        approve()
    return commit(spark, batch_id, attempt, path)


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of committed attempts, with their ``batch_id``."""
    data = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}/*")
    return data.withColumn("attempt", F.col("attempt").cast("string")).join(commits(spark, path), "attempt").drop("attempt")


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    publish({"data": df}, batch_id, path)


def start_atomic(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream into the sink; ``trigger`` defaults to all available data."""
    return (
        df.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    return read_published(spark, path, "data")
