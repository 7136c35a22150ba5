"""Streaming queries, run over what is there; each must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.extract import triggered
from plumbline.plans.registry import Inputs, query
from plumbline.plans.table_queries import CACHE_HITS, TRANSITIONS
from plumbline.plans.views import VIEWS
from plumbline.session import scratch_path
from plumbline.sources.changes import read_change_feed
from plumbline.streaming import atomic, checks, state


def _event_stream(t: Inputs, view: str) -> DataFrame:
    """A view over the events table as a stream."""
    raw = read_change_feed(t.spark, t.sf_dir, t.events.schema, glob="events.parquet")
    return t.spark.sql(VIEWS[view], events=raw)


def _run(t: Inputs, df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(t.spark, label)
    checks.run_available(df, f"{path}/data", f"{path}/checkpoint")
    return t.spark.read.schema(df.schema).parquet(f"{path}/data")


@query("change_feed", """
    SELECT id, element_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, change_type, category FROM {changes}
""")
def change_feed(t: Inputs) -> DataFrame:
    feed = _event_stream(t, "changes").select(
        "id", "element_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "change_type", "category"
    )
    return _run(t, feed, "feed")


_CHANGED = """
        SELECT *, lower(category) = 'wall' AND coalesce(room_type = 'Corridor', false) AND width_mm < min_width AS broken
        FROM (SELECT *, CASE WHEN occupancy > 200 THEN 1500 ELSE 1200 END AS min_width,
                     CASE kind WHEN 'wall' THEN wall_width WHEN 'family' THEN coalesce(width_en, width_cs) END
                         * CAST(304.8 AS DOUBLE) AS width_mm
              FROM {changes} WHERE change_type = 'modified' AND category IN ('Wall', 'Door')) c
"""
_STREAMED = f"SELECT id, element_id, category, width_mm, broken, min_width FROM ({_CHANGED}) d WHERE width_mm IS NOT NULL"


@query("stream_check", f"""
    SELECT id, element_id, category, width_mm, NOT broken AS compliant,
           CASE WHEN broken THEN concat('Corridor width (', width_mm, 'mm) is less than minimum ', min_width,
                                        'mm required by ČSN 73 0802') END AS message
    FROM ({_STREAMED}) s
""")
def stream_check(t: Inputs) -> DataFrame:
    checked = checks.stream_check(t.with_params(_event_stream(t, "changes")))
    return _run(t, checked.select(
        "id", "element_id", "category", "properties.width_mm", "compliant",
        F.get("violations", F.lit(0))["message"].alias("message"),
    ), "checks")


@query("refused_changes", f"""
    SELECT id, element_id, category, 'properties.width_mm.missing' AS reason FROM ({_CHANGED}) d WHERE width_mm IS NULL
""")
def refused_changes(t: Inputs) -> DataFrame:
    return checks.refused_changes(t.with_params(t.changes)).select("id", "element_id", "category", "reason")


@query("request_rate", """
    WITH RECURSIVE w AS (
        SELECT date_trunc('minute', ts) AS s, count(*) AS requests FROM {cache_requests} GROUP BY 1
    )
    SELECT strftime(s, '%Y-%m-%dT%H:%M') AS window_start, requests FROM w
    WHERE s + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM {cache_requests}) - INTERVAL 10 MINUTE
""")
def request_rate(t: Inputs) -> DataFrame:
    rate = checks.request_rate(_event_stream(t, "cache_requests"))
    return _run(t, rate.select(
        F.date_format("window_start", "yyyy-MM-dd'T'HH:mm").alias("window_start"), "requests"
    ), "rate")


@query("atomic_sink", "SELECT id, element_id, category FROM {changes} WHERE change_type = 'modified' AND category IN ('Wall', 'Door')")
def atomic_sink(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "atomic")
    feed = triggered(_event_stream(t, "changes")).select("id", "element_id", "category")
    atomic.start_atomic(feed, f"{path}/sink", f"{path}/checkpoint").awaitTermination()
    return atomic.read_committed(t.spark, f"{path}/sink").drop("batch_id")


@query("stream_result_cache", CACHE_HITS + "SELECT request_id, cache_key, t, hit FROM h")
def stream_result_cache(t: Inputs) -> DataFrame:
    state.use_rocksdb(t.spark)
    return _run(t, state.stream_result_cache(_event_stream(t, "cache_requests")), "cache")


@query("stream_history", f"""
    SELECT element_id, id, transition FROM ({TRANSITIONS}) h JOIN (SELECT id, checked_at FROM {{history}}) USING (id)
    WHERE transition <> 'same' AND checked_at < (SELECT max(checked_at) FROM {{history}}) - INTERVAL 10 MINUTE
""")
def stream_history(t: Inputs) -> DataFrame:
    state.use_rocksdb(t.spark)
    return _run(t, state.stream_history(_event_stream(t, "history")).drop("t"), "history")
