"""Streams fed by several files must equal their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cache, history, reports
from plumbline.plans.registry import Inputs
from plumbline.session import scratch_path
from plumbline.sources.changes import read_change_feed
from plumbline.streaming import atomic, checks, state

from conftest import SF


def feed(spark, df, order, parts=3):
    """The rows in time order, as ``parts`` files read one per micro-batch."""
    path = scratch_path(spark, "feed")
    rows = sorted(df.collect(), key=lambda r: [r[c] for c in order])
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return read_change_feed(spark, path, df.schema, files_per_trigger=1)


def drained(spark, df):
    path = scratch_path(spark, "out")
    query = checks.run_available(df, f"{path}/data", f"{path}/checkpoint")
    assert query.exception() is None
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def test_stream_check_equals_batch(spark):
    t = Inputs(spark, SF)
    changes = t.with_params(t.changes)
    columns = ["id", "compliant", "violations", "recommendations", "checked_at"]
    batch = checks.stream_check(changes).select(*columns)
    stream = drained(spark, checks.stream_check(feed(spark, changes, ["ts"])).select(*columns))
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.collect()))
    picked = checks.change_records(changes).count()
    assert picked == batch.count() + checks.refused_changes(changes).count()
    assert checks.stream_check(changes, enabled=False).count() == 0


def test_stream_cache_equals_batch_over_several_batches(spark):
    state.use_rocksdb(spark)
    requests = Inputs(spark, SF).cache_requests
    batch = {r.request_id: r.hit for r in cache.result_cache(requests).collect()}
    stream = drained(spark, state.stream_result_cache(feed(spark, requests, ["ts"])))
    assert {r.request_id: r.hit for r in stream.collect()} == batch


def test_stream_history_equals_batch_over_several_batches(spark):
    state.use_rocksdb(spark)
    rows = Inputs(spark, SF).history
    batch = history.compliance_history(rows).filter("transition <> 'same'")
    stream = drained(spark, state.stream_history(feed(spark, rows, ["checked_at", "id"])))
    told = rows.agg(F.max("checked_at") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    assert {(r.id, r.transition) for r in stream.collect()} == {(r.id, r.transition) for r in batch.collect() if r.checked_at < told}


def test_stream_history_of_rows_out_of_order(spark):
    state.use_rocksdb(spark)
    start = 1_700_000_000
    parts = [
        [(1, start, True), (1, start + 300, False), (2, start + 10, False)],
        [(1, start + 120, False), (2, start + 5, True), (1, start + 400, True)],  # older than what was read, within the delay
        [(3, start + 5000, True)],
        [(1, start + 60, False)],  # later than the watermark: changes nothing
        [(3, start + 9000, True)],
    ]
    path = scratch_path(spark, "late-history")
    kept = []
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(e, 10 * i + j, s, c) for j, (e, s, c) in enumerate(part)], "element_id long, id long, s long, is_compliant boolean")
        df = df.select("element_id", "id", F.timestamp_seconds("s").alias("checked_at"), "is_compliant")
        df.coalesce(1).write.mode("append").parquet(path)
        kept += df.collect() if i != 3 else []
    stream = drained(spark, state.stream_history(read_change_feed(spark, path, df.schema, files_per_trigger=1)))
    batch = history.compliance_history(spark.createDataFrame(kept, df.schema)).filter("transition <> 'same'")
    assert {(r.id, r.transition) for r in stream.collect()} == {(r.id, r.transition) for r in batch.collect() if r.id < 40}


@pytest.mark.parametrize("slice_seconds", [1, 60, 3600])
def test_stream_history_of_a_hot_element(spark, slice_seconds):
    """A third of all rows belongs to one element, rows come shuffled within the delay, nulls are left out."""
    state.use_rocksdb(spark)
    rnd = random.Random(5)
    start = 1_700_000_000
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 40), i, start + i + rnd.randrange(240), rnd.random() < 0.5) for i in range(3000)]
    end = max(s for _, _, s, _ in rows)
    rows += [(0, None, start + 5, True), (0, 5000, None, True), (0, 5001, start + 6, None), (None, 5002, start + 7, True)]
    rows.sort(key=lambda r: start if r[1] is None else r[1] + start if r[1] < 5000 else start)
    path = scratch_path(spark, "hot-history")
    for i in range(0, len(rows), 800):
        df = spark.createDataFrame(rows[i:i + 800], "element_id long, id long, s long, is_compliant boolean")
        df = df.select("element_id", "id", F.timestamp_seconds("s").alias("checked_at"), "is_compliant")
        df.coalesce(1).write.mode("append").parquet(path)
    source = read_change_feed(spark, path, df.schema, files_per_trigger=1)
    got = drained(spark, state.stream_history(source, slice_seconds=slice_seconds)).collect()
    want, last = set(), {}
    for element, number, second, ok in sorted((r for r in rows if None not in r[1:]), key=lambda r: (r[2], r[1])):
        if second < end - 600 and last.get(element) != ok:
            want.add((element, number, "first" if element not in last else "fixed" if ok else "regressed"))
        last[element] = ok
    assert {(r.element_id, r.id, r.transition) for r in got} == want
    assert len(got) == len(want) and sum(r.element_id == 0 for r in got) > 300


def test_bytes_bound_a_micro_batch(spark):
    rows = Inputs(spark, SF).history
    path = scratch_path(spark, "bounded")
    rows.repartition(4).write.parquet(path)
    source = read_change_feed(spark, path, rows.schema, bytes_per_trigger=1000)
    out = scratch_path(spark, "out")
    query = checks.run_available(source, f"{out}/data", f"{out}/checkpoint")
    assert [p.numInputRows > 0 for p in query.recentProgress].count(True) == 4  # a file at least, no more than the bound
    assert spark.read.parquet(f"{out}/data").count() == rows.count()
    with pytest.raises(ValueError, match="not by both"):
        read_change_feed(spark, SF, rows.schema, files_per_trigger=1, bytes_per_trigger=1000)


def test_hours_of_minutes_as_a_stream(spark):
    """Minutes aggregated to hours and hours to quantiles in one stream: three watermarked aggregations."""
    requests = Inputs(spark, SF).cache_requests.withColumn("event", F.col("ts").cast("timestamp"))
    stream = feed(spark, requests, ["ts"], parts=4).withWatermark("event", "10 minutes")

    def told(df):
        return reports.sketch_quantiles(reports.merge_sketches(reports.latency_sketch(df, F.col("event"))), {"p95": 0.95})

    batch = {r.window_start: (r.requests, r.p95) for r in told(requests).collect()}
    got = {r.window_start: (r.requests, r.p95) for r in drained(spark, told(stream)).collect()}
    assert got and got.items() <= batch.items()
    last = max(r.event for r in requests.select("event").collect())
    assert set(batch) - set(got) <= {h for h in batch if (last - h).total_seconds() < 3600 + 600 + 1}


def test_late_requests_are_dropped(spark):
    rows = [(i, 1_700_000_000 + 60 * i) for i in range(120)]
    late = [(1000, 1_700_000_000)]
    path = scratch_path(spark, "late")
    for part in (rows[:60], rows[60:], late):
        df = spark.createDataFrame(part, "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    stream = read_change_feed(spark, path, df.schema, files_per_trigger=1)
    out = drained(spark, checks.request_rate(stream)).collect()
    assert out and all(r.requests == 1 for r in out)


def test_atomic_sink_hides_unfinished_batches(spark):
    path = scratch_path(spark, "atomic")
    stream = feed(spark, Inputs(spark, SF).changes.select("id", "ts"), ["ts"])
    atomic.start_atomic(stream, path, f"{path}/checkpoint").awaitTermination()
    n = Inputs(spark, SF).events.count()
    assert atomic.read_committed(spark, path).count() == n
    extra = spark.createDataFrame([(1, None)], "id long, ts timestamp_ntz")
    extra.write.parquet(f"{path}/data/attempt=lost")
    assert atomic.read_committed(spark, path).count() == n
    for _ in range(2):
        atomic.write_batch(extra, 99, path)
    assert atomic.read_committed(spark, path).count() == n + 1


def test_replay_of_a_committed_batch_leaves_it_whole(spark):
    path = scratch_path(spark, "replay")
    good = spark.createDataFrame([(1,), (2,)], "id long")
    atomic.write_batch(good, 5, path)
    atomic.write_batch(good.select(F.raise_error(F.lit("lost")).cast("long").alias("id")), 5, path)  # skipped, so it cannot fail
    assert atomic.read_committed(spark, path).count() == 2
    with pytest.raises(Exception, match="lost"):
        atomic.write_batch(good.select(F.raise_error(F.lit("lost")).cast("long").alias("id")), 6, path)
    assert atomic.read_committed(spark, path).count() == 2
    atomic.write_batch(good, 6, path)
    assert sorted(r.id for r in atomic.read_committed(spark, path).collect()) == [1, 1, 2, 2]


def test_error_policy_in_one_pass(spark, tmp_path):
    from plumbline.streaming import policy

    good = '{"element_type": "Wall", "properties": {"width_mm": 1}}'
    rows = [(i, good if i % 4 else "{}") for i in range(40)]
    df, path = spark.createDataFrame(rows, "id int, json string"), str(tmp_path / "isolated")
    assert policy.store_requests(df, 0, path) == {"rows": 40, "rejected": 10}
    assert policy.store_requests(df, 0, path) is None  # a replay changes nothing
    valid, rejected = policy.stored_requests(spark, path)
    assert sorted(r.id for r in valid.collect()) == [i for i in range(40) if i % 4]
    assert sorted((r.id, r.json) for r in rejected.collect()) == [(i, "{}") for i in range(0, 40, 4)]
    assert {tuple(r.reasons) for r in rejected.collect()} == {("properties.missing", "element_type.missing")}

    strict = str(tmp_path / "strict")
    with pytest.raises(policy.RejectedRequests, match="10 of 40"):
        policy.store_requests(df, 0, strict, "fail")
    assert policy.store_requests(df, 1, strict, "fail", allowed=10)["rejected"] == 10
    assert policy.store_requests(df.filter("id % 4 > 0"), 2, strict, "fail") == {"rows": 30, "rejected": 0}
    assert policy.stored_requests(spark, strict)[0].groupBy("batch_id").count().orderBy("batch_id").collect() == [(1, 30), (2, 30)]
    with pytest.raises(ValueError):
        policy.store_requests(df, 3, strict, "ignore")


def test_error_policy_of_a_stream(spark, tmp_path):
    from plumbline.streaming import policy

    source = tmp_path / "in"
    source.mkdir()
    good = '{"element_type": "Wall", "properties": {"width_mm": 1}}'
    (source / "a.txt").write_text("\n".join([good, "{}", good]))
    feed = spark.readStream.text(str(source)).withColumnRenamed("value", "json")
    policy.start_request_store(feed, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [df.count() for df in policy.stored_requests(spark, str(tmp_path / "out"))] == [2, 1]
    broken = policy.start_request_store(feed, str(tmp_path / "out2"), str(tmp_path / "check2"), "fail")
    with pytest.raises(Exception, match="rejected requests: 1 of 3"):
        broken.awaitTermination()


def test_of_two_writers_of_a_batch_one_wins(spark):
    from threading import Barrier, Thread

    path, both, won = scratch_path(spark, "writers"), Barrier(2, timeout=60), {}

    def write(name):  # both have found the batch unpublished before either commits
        won[name] = atomic.publish({"data": spark.range(5).withColumn("writer", F.lit(name))}, 7, path, approve=both.wait)

    threads = [Thread(target=write, args=(name,)) for name in "ab"]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(won.values()) == [False, True]
    rows = atomic.read_committed(spark, path).collect()
    assert [r.batch_id for r in rows] == [7] * 5 and {r.writer for r in rows} == {name for name in won if won[name]}
    assert not atomic.publish({"data": spark.range(1)}, 7, path)


def test_ids_of_any_batch(spark):
    from plumbline.operators import persist

    ids = [r.id for batch in (0, 32_768, 40_000, 1 << 60) for r in persist.numbered(spark.range(0, 100, 1, 3).drop("id"), batch).collect()]
    assert len(set(ids)) == 400 and None not in ids and ids == sorted(ids)
