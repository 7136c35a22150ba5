"""Result cache with a time to live, replayed over a request log.

The first request of a key computes.  Requests less than ``ttl`` after *that* request are
hits; the next one after it computes again and becomes the new anchor.  Finding the
anchors is a chain per key, and one key may hold a third of the log, so the chain is cut
into time slices:

1. per (key, slice), on distinct times: where would the chain leave the slice, for every
   point it could enter at;
2. per key, over those few entry points: the entry each slice really gets;
3. per (key, slice): walk from that entry and emit the anchors.

Times are microseconds.  The log itself is never grouped: anchors are joined back to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TTL = 3600
DEFAULT_SLICE = 86400


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _exits(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each time taken as an anchor, the last anchor of its chain (jump doubling)."""
    jump = np.searchsorted(times, times + ttl)
    step = np.where(jump < len(times), jump, np.arange(len(times)))
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return times[step]
        step = further


def _slice_summary(ttl: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy())
        start = key[1]
        exits = _exits(times, ttl)
        # an earlier anchor lies before the slice, so the chain enters within one ttl of
        # its start, or at the first time after that
        entries = int(np.searchsorted(times, start + ttl)) + 1
        entries = min(entries, len(times))
        entry, leave = times[:entries], exits[:entries]
        # entries are looked up as "first entry >= x": of a run with equal exits only the last counts
        last_of_run = np.append(leave[1:] != leave[:-1], True)
        return pd.DataFrame({
            "key": key[0], "slice": start, "entry": entry[last_of_run], "leave": leave[last_of_run],
        })

    return run


def _stitch(ttl: int):
    """Walks the slices of each key in order; rows arrive sorted by (key, slice, entry).

    Holds one anchor, whatever the number of rows; each slice is one binary search.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = slice_ = anchor = None
        settled = False
        for pdf in batches:
            keys, slices = pdf["key"].to_numpy(), pdf["slice"].to_numpy()
            entry, leave = pdf["entry"].to_numpy(), pdf["leave"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])) + 1
            out = []
            for begin, end in zip([0, *cuts], [*cuts, len(pdf)]):
                if begin == end:
                    continue
                if keys[begin] != key:
                    key, slice_, anchor = keys[begin], None, None
                if slices[begin] != slice_:
                    slice_, settled = slices[begin], False
                if settled:
                    continue
                least = slice_ if anchor is None else anchor + ttl
                at = begin + int(np.searchsorted(entry[begin:end], least))
                if at < end:
                    out.append((key, slice_, least))
                    anchor, settled = leave[at], True
            yield pd.DataFrame(out, columns=["key", "slice", "least"])

    return run


def _walk(ttl: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy())
        least, anchors = pdf["least"].iloc[0], []
        at = int(np.searchsorted(times, least))
        while at < len(times):
            anchors.append(times[at])
            at = int(np.searchsorted(times, times[at] + ttl))
        return pd.DataFrame({"key": key[0], "t": np.array(anchors, dtype="int64")})

    return run


def cache_anchors(requests: DataFrame, key: str = "cache_key", ts: str = "ts",
                  ttl: int = DEFAULT_TTL, slice_seconds: int = DEFAULT_SLICE) -> DataFrame:
    """``key, t`` of every request time that computes (``t`` in microseconds).

    ``slice_seconds`` bounds what one task sorts: the distinct times of one key in one slice.
    Step 2 reads about ttl / slice of the distinct times of a key.
    """
    ttl_us = ttl * 1_000_000
    width = slice_seconds * 1_000_000
    keyed = requests.filter(F.col(key).isNotNull())
    times = keyed.select(F.col(key).alias("key"), _micros(F.col(ts)).alias("t")).distinct()
    times = times.withColumn("slice", F.col("t") - F.pmod(F.col("t"), F.lit(width)))
    group = times.groupBy("key", "slice")
    summary = group.applyInPandas(_slice_summary(ttl_us), "key string, slice long, entry long, leave long")
    entered = (
        summary.repartition("key").sortWithinPartitions("key", "slice", "entry")
        .mapInPandas(_stitch(ttl_us), "key string, slice long, least long")
    )
    walked = times.join(entered, ["key", "slice"]).groupBy("key", "slice")
    return walked.applyInPandas(_walk(ttl_us), "key string, t long")


def result_cache(requests: DataFrame, key: str = "cache_key", ts: str = "ts", order: str = "request_id",
                 ttl: int = DEFAULT_TTL, slice_seconds: int = DEFAULT_SLICE) -> DataFrame:
    """The requests with ``hit``.

    Of requests at one anchor time the smallest ``order`` computes; one without a key always does.
    """
    anchors = cache_anchors(requests, key, ts, ttl, slice_seconds).select(
        F.col("key").alias(key), F.col("t").alias("_t"), F.lit(True).alias("_anchor")
    )
    rows = requests.withColumn("_t", _micros(F.col(ts)))
    first = rows.join(anchors, [key, "_t"], "left_semi").groupBy(key, "_t").agg(F.min(order).alias("_first"))
    out = rows.join(first, [key, "_t"], "left")
    hit = F.col(key).isNotNull() & F.coalesce(F.col(order) != F.col("_first"), F.lit(True))
    return out.select(*requests.columns, hit.alias("hit"))


def cache_hit_rate(requests: DataFrame, key: str = "cache_key", ts: str = "ts",
                   ttl: int = DEFAULT_TTL, slice_seconds: int = DEFAULT_SLICE) -> DataFrame:
    """One row ``requests, hits, hit_rate``: a miss is an anchor or has no key, so counts suffice."""
    anchors = cache_anchors(requests, key, ts, ttl, slice_seconds)
    counts = requests.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(key).isNull()).alias("misses")
    )
    misses = anchors.agg(F.count(F.lit(1)).alias("misses")).withColumn("requests", F.lit(0).cast("long"))
    total = counts.unionByName(misses).agg(
        F.sum("requests").alias("requests"), F.sum("misses").alias("misses")
    )
    hits = F.col("requests") - F.col("misses")
    return total.select("requests", hits.alias("hits"), F.round(hits / F.nullif("requests", F.lit(0)), 6).alias("hit_rate"))
