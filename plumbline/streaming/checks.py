"""Change feed -> checked elements, with the batch Column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.corridor import check_corridor
from plumbline.operators.extract import extract_properties, relevant, triggered, with_context
from plumbline.operators.reports import rate_per_window

WATERMARK = "10 minutes"


def change_records(changes: DataFrame, enabled: bool = True) -> DataFrame:
    """Triggered and relevant changes as check records."""
    picked = relevant(triggered(changes, enabled))
    return with_context(
        extract_properties(picked), F.col("room_type"), F.col("floor_level"), occupancy=F.col("occupancy")
    )


def stream_check(changes: DataFrame, enabled: bool = True) -> DataFrame:
    """Checked changes; stateless, so it runs in append mode and as a batch alike.

    A record without a width would be refused by the check; ``refused_changes`` keeps those.
    """
    records = change_records(changes, enabled).filter(F.col("properties.width_mm").isNotNull())
    return check_corridor(records, F.col("ts"))


def refused_changes(changes: DataFrame, enabled: bool = True) -> DataFrame:
    """Changes the check refuses, with the reason."""
    records = change_records(changes, enabled).filter(F.col("properties.width_mm").isNull())
    return records.withColumn("reason", F.lit("properties.width_mm.missing"))


def request_rate(requests: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Requests per tumbling minute; windows close with the watermark, later rows are dropped."""
    stamped = requests.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", delay)
    return rate_per_window(stamped, F.col("_event"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there into parquet files and stops."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query
