"""Error policy of check requests: one pass over a batch stores good and bad rows apart and counts them on the way.

The batch is published by attempt and commit.  Its counts are known when its files are written and before they are published, so ``fail``
is a threshold on them: a batch with more bad rows than allowed stays unpublished, whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.requests import read_check_requests
from plumbline.streaming.atomic import publish, read_published

POLICIES = ("isolate", "fail")


class RejectedRequests(Exception):
    """More rejected rows than a batch may hold."""

    def __init__(self, rejected: int, rows: int):
        super().__init__(f"rejected requests: {rejected} of {rows}")
        self.rejected, self.rows = rejected, rows


def store_requests(df: DataFrame, batch_id: int, path: str, policy: str = "isolate", allowed: int = 0, json: str = "json") -> dict[str, int] | None:
    """Publishes a batch under ``policy`` and tells ``rows`` and ``rejected``; None for a batch published before."""
    if policy not in POLICIES:
        raise ValueError(f"unknown error policy: {policy}")
    bad, counts = F.size("reasons") > 0, Observation()
    parsed = read_check_requests(df, json).withColumn("rejected", bad)
    told = F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("rejected"), 1)).alias("rejected")

    def approve() -> None:
        if policy == "fail" and counts.get["rejected"] > allowed:
            raise RejectedRequests(counts.get["rejected"], counts.get["rows"])

    done = publish({"requests": parsed.observe(counts, *told)}, batch_id, path, {"requests": "rejected"}, approve)
    return dict(counts.get) if done else None


def stored_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Published rows as ``(valid, rejected)``; either reads its own folders only."""
    rows = read_published(spark, path, "requests")
    good = rows.filter("rejected = 'false'").drop("rejected", "reasons")
    return good, rows.filter("rejected = 'true'").drop("rejected", "element_type", "properties", "context")


def start_request_store(df: DataFrame, path: str, checkpoint: str, policy: str = "isolate", allowed: int = 0, **trigger) -> StreamingQuery:
    """The same for a stream of requests; ``fail`` ends it at the first batch that has too many bad rows."""
    return (
        df.writeStream.foreachBatch(lambda batch, batch_id: store_requests(batch, batch_id, path, policy, allowed) and None)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
