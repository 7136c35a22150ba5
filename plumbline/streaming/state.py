"""Keyed state: the result cache and the state changes per element.

State lives in RocksDB, sharded by key, one small value per key.  A key's rows of one
micro-batch are handled together, so ``maxFilesPerTrigger`` (or its like) bounds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.cache import DEFAULT_TTL
from plumbline.streaming.checks import WATERMARK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store provider these operators need; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _CacheProcessor(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t", "request_id"])
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        hits = []
        for t in batch["t"]:
            hit = anchor is not None and t < anchor + self.ttl
            hits.append(hit)
            anchor = anchor if hit else int(t)
        self.anchor.update((anchor,))
        # an anchor the watermark has left behind by one ttl can serve no one
        self.handle.registerTimer((anchor + self.ttl) // 1000 + 1)
        yield pd.DataFrame({
            "cache_key": key[0], "request_id": batch["request_id"], "t": batch["t"], "hit": hits,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.anchor.exists():
            limit = (self.anchor.get()[0] + self.ttl) // 1000
            if limit < expiredTimerInfo.getExpiryTimeInMs():
                self.anchor.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_result_cache(requests: DataFrame, ttl: int = DEFAULT_TTL, delay: str = WATERMARK) -> DataFrame:
    """Requests (``cache_key, request_id, ts``) with ``hit``; the batch twin is ``result_cache``.

    Times are compared as event time.  A request older than its anchor counts as a hit.
    """
    stamped = requests.withColumn("event", F.col("ts").cast("timestamp")).withWatermark("event", delay)
    timed = stamped.select("cache_key", "request_id", "event", F.unix_micros("event").alias("t"))
    return timed.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=_CacheProcessor(ttl),
        outputStructType="cache_key string, request_id long, t long, hit boolean",
        outputMode="Append", timeMode="EventTime",
    )


_ROW = np.dtype([("t", "<i8"), ("id", "<i8"), ("ok", "?")])  # a waiting row, packed
_ENTRY = np.dtype([("entry", "<i8"), ("first", "<i8")])  # an entry of waiting rows and its earliest time, packed
# Rows from which an entry is full: a frame's rows are cut at the next slice.
ENTRY_ROWS = 512
# Rows from which waiting entries are merged while they are told.
MERGED_ROWS = 65536


class _HistoryProcessor(StatefulProcessor):
    """Holds rows until the watermark has passed them, then labels them in time order.

    The rows of a frame wait sorted, in packed entries of as many time slices as fill one, so state calls follow the number of keys and of
    full entries and not that of slices.  Entries are told in the order of their earliest rows, and what no later entry can
    precede leaves at once: memory is a frame, or the entries of one key that overlap at one time (one for each frame), and an index
    of two numbers for each entry.
    """

    def __init__(self, slice_ms: int):
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "compliant boolean")
        self.index = handle.getValueState("index", "entries binary")
        self.waiting = handle.getMapState("waiting", "entry long", "rows binary")

    def _entries(self) -> dict[int, int]:
        held = self.index.get()
        return dict(np.frombuffer(bytes(held[0]), _ENTRY).tolist()) if held else {}

    def _keep(self, entries: dict[int, int]) -> None:
        self.index.update((np.array(list(entries.items()), _ENTRY).tobytes(),))

    def _groups(self, rows: np.ndarray) -> list[np.ndarray]:
        """Sorted rows, cut where a slice begins and the rows before it fill an entry."""
        cuts = []
        for begin in (np.flatnonzero(np.diff(rows["t"] // 1000 // self.slice_ms)) + 1).tolist():
            if begin - (cuts[-1] if cuts else 0) >= ENTRY_ROWS:
                cuts.append(begin)
        return [group for group in np.split(rows, cuts) if len(group)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = timerValues.getCurrentWatermarkInMs()
        entries = self._entries()
        due = min(entries.values(), default=None)
        number = max(entries, default=-1) + 1
        for frame in rows:
            found = np.empty(len(frame), _ROW)
            found["t"], found["id"], found["ok"] = frame["t"], frame["id"], frame["is_compliant"]
            found = found[found["t"] // 1000 + 1 > told]
            found.sort(order="t")
            for held in self._groups(found):
                self.waiting.updateValue((number,), (held.tobytes(),))
                entries[number] = int(held["t"][0])
                number += 1
        if entries:
            self._keep(entries)
            earliest = min(entries.values())
            if due is None or earliest < due:
                self.handle.registerTimer(earliest // 1000 + 1)
        return iter([])

    def _passed(self, entries: dict[int, int], told: int) -> Iterator[np.ndarray]:
        """Waiting rows that the watermark has passed, in time order; takes them out of the state and of ``entries``."""
        due = sorted((first, entry) for entry, first in entries.items() if first // 1000 + 1 <= told)
        held: list[np.ndarray] = []
        size, limit = 0, MERGED_ROWS
        for at, (_, entry) in enumerate(due):
            rows = np.frombuffer(bytes(self.waiting.getValue((entry,))[0]), _ROW)
            passed = rows["t"] // 1000 + 1 <= told
            later = rows[~passed]
            del entries[entry]
            if len(later):
                self.waiting.updateValue((entry,), (later.tobytes(),))
                entries[entry] = int(later["t"].min())
            held.append(rows[passed])
            size += len(held[-1])
            final = at + 1 == len(due)
            if final or size >= limit:
                merged = np.sort(np.concatenate(held), order=["t", "id"])
                cut = len(merged) if final else int(np.searchsorted(merged["t"], due[at + 1][0]))
                if cut:
                    yield merged[:cut]
                held, size = [merged[cut:]], len(merged) - cut
                limit = max(MERGED_ROWS, 2 * size)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer set before an earlier row came finds its rows told already
        told = timerValues.getCurrentWatermarkInMs()
        entries = self._entries()
        before_told = set(entries)
        if not any(first // 1000 + 1 <= told for first in entries.values()):
            return
        known = self.last.get()
        last = bool(known[0]) if known else None
        for ready in self._passed(entries, told):
            ok = ready["ok"]
            before = np.concatenate([[not ok[0] if last is None else last], ok[:-1]])
            transition = np.where(ok, "fixed", "regressed").astype(object)
            if last is None:
                transition[0] = "first"
            changed = ok != before
            last = bool(ok[-1])
            if changed.any():
                yield pd.DataFrame({
                    "element_id": pd.array([key[0] if key[1] else None], "Int64").repeat(changed.sum()),
                    "id": ready["id"][changed], "t": ready["t"][changed], "transition": transition[changed],
                })
        self.last.update((last,))
        if entries:
            for entry in before_told - set(entries):
                self.waiting.removeKey((entry,))
            self._keep(entries)
            self.handle.registerTimer(min(entries.values()) // 1000 + 1)
        else:
            self.waiting.clear()
            self.index.clear()

    def close(self) -> None:
        pass


def stream_history(checks: DataFrame, delay: str = WATERMARK, slice_seconds: int = 60) -> DataFrame:
    """State changes per element (first, fixed, regressed); the batch twin is
    ``compliance_history`` without its ``same`` rows.

    A change is told once the watermark has passed it, so rows may come in any order within ``delay``; rows later
    than that are dropped and change nothing that was told.  Waiting rows lie in entries of some hundred rows, cut where a time slice of
    ``slice_seconds`` begins: a task holds, for each frame that brought rows of an element, one entry at a time.  Checks
    without a time, an id or an outcome are left out.
    """
    whole = checks.dropna(subset=["checked_at", "id", "is_compliant"])
    stamped = whole.withColumn("event", F.col("checked_at").cast("timestamp")).withWatermark("event", delay)
    # a null key is not told apart from its neighbours in Python workers, so the key holds no null
    timed = stamped.select(
        F.coalesce("element_id", F.lit(0)).alias("element"), F.col("element_id").isNotNull().alias("known"),
        "id", "event", F.unix_micros("event").alias("t"), "is_compliant",
    )
    return timed.groupBy("element", "known").transformWithStateInPandas(
        statefulProcessor=_HistoryProcessor(slice_seconds * 1000),
        outputStructType="element_id long, id long, t long, transition string",
        outputMode="Append", timeMode="EventTime",
    )
