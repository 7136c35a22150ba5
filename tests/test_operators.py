"""Operators against brute force on small inputs, hot keys included, and their plans."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF
from plumbline.operators import cache, enrich, graph, history, integrity, persist, reports, retrieval, rules
from plumbline.plans.registry import Inputs
from plumbline.session import cut_lineage, scratch_path
from plumbline.sources import documents, tables


def plan(df):
    return df._jdf.queryExecution().toString()


# ---------------------------------------------------------------- rooms

def random_rooms(seed, n):
    rnd = random.Random(seed)
    rooms = []
    for i in range(n):
        x0, y0 = rnd.uniform(-20, 60), rnd.uniform(-20, 60)
        rooms.append((i, rnd.randrange(2), f"r{i}", x0, x0 + rnd.uniform(1, 40), y0, y0 + rnd.uniform(1, 40)))
    return rooms


@pytest.mark.parametrize("n_rooms", [60, 600])
def test_join_rooms_matches_brute_force(spark, n_rooms):
    rooms = random_rooms(1, n_rooms)
    rnd = random.Random(2)
    points = [
        (None if i % 50 == 0 else f"e{i // 2}", rnd.randrange(3), "curve" if i % 9 == 0 else "point",
         None if i % 13 == 0 else rnd.uniform(-30, 90), rnd.uniform(-30, 90)) for i in range(400)
    ]
    elements = spark.createDataFrame(points, "element_id string, level_id int, location_kind string, x double, y double")
    lookup = spark.createDataFrame(
        rooms, "room_id long, level_id int, name string, x0 double, x1 double, y0 double, y1 double")
    got = enrich.join_rooms(elements, lookup).collect()
    want = []
    for name, level, kind, x, y in points:
        hits = [r[0] for r in rooms if kind == "point" and x is not None and r[1] == level
                and r[3] <= x < r[4] and r[5] <= y < r[6]]
        want.append((name, level, kind, x, y, min(hits) if hits else None, f"r{min(hits)}" if hits else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rooms_in_another_unit_do_not_explode(spark):
    rows = [(i, 0, f"r{i}", i * 3000.0, i * 3000.0 + 3000, 0.0, 4000.0) for i in range(20)] + [(99, 0, "hall", 0.0, 1e9, 5000.0, 1e9)]
    rooms = spark.createDataFrame(rows, "room_id long, level_id int, name string, x0 double, x1 double, y0 double, y1 double")
    cells = enrich.room_cells(rooms, enrich.cell_size(rooms))
    assert cells.groupBy("room_id").count().agg({"count": "max"}).first()[0] < 10_000


def test_adjacent_rooms_matches_brute_force(spark):
    rnd = random.Random(3)
    rooms = []
    for i in range(80):
        x0, y0 = rnd.randrange(0, 60, 7), rnd.randrange(0, 60, 9)
        rooms.append((i, rnd.randrange(2), f"r{i}", float(x0), float(x0 + rnd.choice([7, 14, 21])),
                      float(y0), float(y0 + rnd.choice([9, 18]))))
    df = spark.createDataFrame(rooms, "room_id long, level_id int, name string, x0 double, x1 double, y0 double, y1 double")
    got = sorted((r.room_a, r.room_b) for r in graph.adjacent_rooms(df).collect())
    want = []
    for a in rooms:
        for b in rooms:
            if a[0] < b[0] and a[1] == b[1]:
                along_y = max(a[5], b[5]) < min(a[6], b[6]) and (a[4] == b[3] or b[4] == a[3])
                along_x = max(a[3], b[3]) < min(a[4], b[4]) and (a[6] == b[5] or b[6] == a[5])
                if along_x or along_y:
                    want.append((a[0], b[0]))
    assert got == sorted(want)


def test_room_and_rule_joins_have_no_pairwise_plan(spark):
    t = Inputs(spark, SF)
    placed = t.placed()
    for df in (
        enrich.join_rooms(t.raw_elements, t.rooms),
        rules.evaluate_rules(placed, rules.active_rules(t.rules, None)),
        rules.elements_without_rules(placed, t.rules), graph.adjacent_rooms(t.rooms), rules.list_rules(t.rules),
    ):
        text = plan(df)
        assert not any(bad in text for bad in ("CartesianProduct", "NestedLoop", "BatchEvalPython", "Join Cross"))


def test_corridor_check_is_narrow_and_pruned(spark):
    from plumbline.operators.corridor import check_corridor

    t = Inputs(spark, SF)
    text = plan(check_corridor(t.records(t.elements)))
    assert "Exchange" not in text.split("== Physical Plan ==")[1]
    assert "l_extendedprice" not in text.split("ReadSchema")[1]


# ---------------------------------------------------------------- history and cache

@pytest.mark.parametrize("time_slice", ["hour", "day", "year"])
def test_history_does_not_depend_on_slices(spark, time_slice):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        key = 0 if rnd.random() < 0.5 else rnd.randrange(1, 20)
        rows.append((i, key, 1_700_000_000 + rnd.randrange(0, 5 * 86400), rnd.random() < 0.5))
    df = spark.createDataFrame(rows, "id long, element_id long, s long, is_compliant boolean").withColumn(
        "checked_at", F.timestamp_seconds("s"))
    got = {r.id: (r.transition, r.days_in_state) for r in history.compliance_history(df, time_slice).collect()}
    last, since = {}, {}
    for i, key, s, state in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        label = "first" if key not in last else "same" if last[key] == state else "fixed" if state else "regressed"
        if label != "same":
            since[key] = s
        last[key] = state
        assert got[i] == (label, (s - since[key]) // 86400)
    latest = {r.element_id: r.id for r in history.latest_result(df).collect()}
    assert latest == {k: max((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))[0] for k in last}


def brute_hits(rows, ttl):
    anchor, hits = {}, {}
    for rid, key, s in sorted(rows, key=lambda r: (r[2], r[0])):
        hits[rid] = key is not None and key in anchor and s < anchor[key] + ttl
        if not hits[rid]:
            anchor[key] = s
    return hits


@pytest.mark.parametrize("slice_seconds", [30, 1000, 100_000])
def test_cache_does_not_depend_on_slices(spark, slice_seconds):
    rnd = random.Random(7)
    rows = []
    for i in range(1500):
        key = rnd.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((i, key, 1_700_000_000 + rnd.choice([rnd.randrange(20_000), 20_000 + rnd.randrange(300) * 90])))
    df = spark.createDataFrame(rows, "request_id long, cache_key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: r.hit for r in cache.result_cache(df, ttl=100, slice_seconds=slice_seconds).collect()}
    want = brute_hits(rows, 100)
    assert got == want
    rate = cache.cache_hit_rate(df, ttl=100, slice_seconds=slice_seconds).first()
    assert (rate.requests, rate.hits) == (len(rows), sum(want.values()))


def test_latency_quantile(spark):
    rnd = random.Random(9)
    rows = [(60 * rnd.randrange(3), round(rnd.uniform(0, 50), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s long, latency double").withColumn("ts", F.timestamp_seconds("s"))
    for r in reports.latency_profile(df).collect():
        values = sorted(v for s, v in rows if s == r.minute.timestamp())
        assert r.requests == len(values)
        assert r.latency_quantile == values[math.ceil(len(values) * 0.95) - 1]


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_merged_sketches_keep_their_error_bound(spark, accuracy):
    """Latencies over nine powers of ten, one hour with a third of them, zeros, nulls and NaN."""
    rnd = random.Random(3)
    rows = [(0 if i % 3 == 0 else rnd.randrange(5 * 3600), 10 ** rnd.uniform(-5, 4)) for i in range(4000)]
    rows += [(4000, 0.0), (4001, None), (4002, float("nan")), (9 * 3600, 0.0), (9 * 3600, -1.0), (9 * 3600, 2.0)]
    df = spark.createDataFrame(rows, "s long, latency double").withColumn("ts", F.timestamp_seconds("s"))
    minutes = reports.latency_sketch(df, F.col("ts"), accuracy=accuracy)
    qs = {f"q{int(q * 1000)}": q for q in (0.001, 0.25, 0.5, 0.95, 0.999, 1.0)}
    got = reports.sketch_quantiles(reports.merge_sketches(minutes), qs, accuracy).collect()
    hours = {}
    for s, v in rows:
        if v is not None and not math.isnan(v):
            hours.setdefault(s // 3600, []).append(max(v, 0.0))
    assert {int(r.window_start.timestamp()) // 3600: r.requests for r in got} == {h: len(v) for h, v in hours.items()}
    for r in got:
        values = sorted(hours[int(r.window_start.timestamp()) // 3600])
        for name, q in qs.items():
            exact = values[math.ceil(len(values) * q) - 1]
            assert abs(r[name] - exact) <= accuracy * exact * (1 + 1e-9)
    # what is shuffled is counts of steps: the latency is gone below the first exchange
    plan = reports.merge_sketches(minutes)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial_") >= 1 and "latency" not in plan.split("HashAggregate")[1]
    assert reports.sketch_quantiles(reports.merge_sketches(minutes.limit(0)), qs, accuracy).count() == 0
    with pytest.raises(ValueError, match="accuracy"):
        reports.latency_sketch(df, F.col("ts"), accuracy=1.5)


def contains(spark, pairs):
    return spark.createDataFrame([(a, b, "CONTAINS") for a, b in pairs] + [("x", "y", "CONNECTS_TO")], "src string, dst string, rel string")


def test_intervals_and_what_lies_below(spark):
    """Random forest with one holder of a third of all nodes, a repeated edge and null ends."""
    rnd = random.Random(8)
    parent = {f"n{i}": "n0" if i % 3 == 0 else f"n{rnd.randrange(i)}" for i in range(1, 300) if i % 50}
    pairs = [*parent.items()]
    edges = contains(spark, [(p, c) for c, p in pairs] + [("n0", "n3"), (None, "n5"), ("n5", None)])

    def ancestors(node):
        while node in parent:
            node = parent[node]
            yield node

    nodes = set(parent) | set(parent.values())
    labels = graph.containment_intervals(edges).cache()
    got = {r.id: r for r in labels.collect()}
    assert set(got) == nodes and sorted(r.first for r in got.values()) == list(range(len(nodes)))
    ways = sorted((list(ancestors(n))[::-1] + [n], n) for n in nodes)
    assert [n for _, n in ways] == sorted(nodes, key=lambda n: got[n].first)
    want = {(a, n, d) for n in nodes for d, a in enumerate(ancestors(n), 1)}
    for n in nodes:
        assert (got[n].parent, got[n].level) == (parent.get(n), len(list(ancestors(n))))
        assert got[n].last - got[n].first == sum(a == n for a, _, _ in want)
    for piece in (1, 7, 4096):
        rows = graph.below(labels, labels, piece).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    one = graph.below(labels, spark.createDataFrame([("n0",), ("n0",), ("none",), (None,)], "id string")).collect()
    assert {tuple(r) for r in one} == {w for w in want if w[0] == "n0"} and len(one) == len(set(one))
    assert {tuple(r) for r in graph.containment_closure(contains(spark, [(p, c) for c, p in pairs])).collect()} == want


def test_intervals_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    labels = graph.containment_intervals(contains(spark, [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)]))
    got = sorted(labels.collect(), key=lambda r: r.first)
    assert [(r.id, r.level, r.last) for r in got] == [(f"c{i:03}", i, 200) for i in range(201)]
    assert len(cuts) == 3 + 8  # edges, first ways and order, and a round for each binary digit of 200


@pytest.mark.parametrize("pairs, error", [
    ([("a", "a")], "contains itself"), ([("r", "s"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "contains itself"),
    ([("a", "c"), ("b", "c")], "two parents"),
])
def test_intervals_refuse_what_is_no_forest(spark, pairs, error):
    with pytest.raises(ValueError, match=error):
        graph.containment_intervals(contains(spark, pairs))


def test_intervals_of_nothing(spark):
    labels = graph.containment_intervals(contains(spark, []))
    assert labels.count() == 0 and graph.below(labels, labels).count() == 0


# ---------------------------------------------------------------- rules, storage and integrity

def test_new_rule_type_can_be_registered(spark):
    elements = spark.createDataFrame(
        [("e", "Wall", "Office", 100.0, 5.0)], "element_id string, element_type string, building_type string, width_mm double, height_mm double")
    rule = spark.createDataFrame(
        [("R", "max_width", "wall", ["office"], 50.0, "info", "S1")],
        "rule_id string, rule_type string, geometry_type string, building_types array<string>, value_mm double, severity string, code_reference string")
    assert rules.evaluate_rules(elements, rule).count() == 0
    assert rules.unevaluated_rules(elements, rule).first().unevaluated == 1
    rules.register_evaluator("max_width", "width_mm", lambda value, limit: value > limit)
    try:
        assert rules.evaluate_rules(elements, rule).first().actual_value == 100.0
    finally:
        del rules.EVALUATORS["max_width"]


def test_empty_catalogue_gives_message(spark):
    empty = Inputs(spark, SF).rules.filter(F.lit(False))
    rows = rules.list_rules(empty).collect()
    assert [(r.total_rules, r.rule_id, r.message) for r in rows] == [(0, None, rules.EMPTY_CATALOGUE)]


def test_persist_of_two_batches_has_fresh_ids(spark):
    from plumbline.plans.table_queries import _rules_with_builtin

    t, path = Inputs(spark, SF), scratch_path(spark, "persist")
    checked = t.checked().drop("id").filter("not compliant")
    n = checked.count()
    for batch in range(2):
        unmatched = persist.persist(checked, _rules_with_builtin(t), path, batch, grain="year")
    assert unmatched.count() == 0
    checks = persist.read_stored(spark, path, "compliance_checks")
    results = persist.read_stored(spark, path, "check_results")
    assert checks.count() == results.count() == 2 * n
    stored = {"compliance_checks": checks, "check_results": results, "compliance_rules": _rules_with_builtin(t)}
    assert integrity.unique_report({k: stored[k] for k in ("compliance_checks", "check_results")}).count() == 0
    assert integrity.orphan_report(stored).count() == 0


def test_json_columns_round_trip(spark):
    stored = Inputs(spark, SF).rules.select("id", "building_types")
    back = tables.decode_json(tables.encode_json(stored, "compliance_rules"), "compliance_rules")
    assert back.exceptAll(stored).count() == 0


# ---------------------------------------------------------------- retrieval

def vectors(seed, n, dim=8, copies=0):
    rnd = np.random.default_rng(seed)
    data = rnd.standard_normal((n, dim)).astype("float32")
    if copies:
        data[:copies] = data[0]
    return data


def frame(spark, data, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def brute_top(index, queries, k, least):
    def unit(m):
        m = m.astype("float64")
        return m / np.sqrt((m * m).sum(1))[:, None]

    scores = np.round(unit(queries) @ unit(index).T, 6)
    return {
        (q, c): rank for q, row in enumerate(scores)
        for rank, c in enumerate(sorted((c for c in range(len(row)) if row[c] >= least), key=lambda c: (-row[c], c))[:k], 1)
    }


@pytest.mark.parametrize("block_rows", [16384, 64])
def test_search_matches_brute_force_with_many_copies(spark, block_rows):
    index, queries = vectors(1, 300, copies=100), vectors(1, 40, copies=10)
    found = retrieval.vector_search(
        frame(spark, index, "chunk_id"), frame(spark, queries, "query_id"), 7, 0.3, block_rows=block_rows)
    assert not any(bad in plan(found) for bad in ("NestedLoop", "Cartesian"))
    got = {(r.query_id, r.chunk_id): r["rank"] for r in found.collect()}
    assert got == brute_top(index, queries, 7, 0.3)


def test_filtered_search_matches_brute_force(spark):
    t = Inputs(spark, SF)
    rows = {r.chunk_id: r for r in t.vectors.collect()}
    asked = t.vectors.withColumnRenamed("chunk_id", "query_id")
    want = {}
    for q, a in rows.items():
        index = [c for c, b in rows.items() if c != q and a.geometry_type == b.geometry_type and a.language == b.language
                 and (b.building_types is None or a.building_type in b.building_types)]
        data = np.array([rows[c].embedding for c in index])
        ranked = brute_top(data, np.array([a.embedding]), 3, 0.1) if index else {}
        want |= {(q, index[c]): rank for (_, c), rank in ranked.items()}
    for block_rows in (16384, 50):
        found = retrieval.filtered_search(t.vectors, asked, 3, 0.1, skip_self=True, block_rows=block_rows)
        assert {(r.query_id, r.chunk_id): r["rank"] for r in found.collect()} == want


def test_small_blocks_change_nothing(spark):
    index, queries = vectors(3, 200), vectors(4, 60)
    key = [F.lit("b").alias("bucket")]
    parts = retrieval.block_search(
        frame(spark, index, "chunk_id").select("*", *key), frame(spark, queries, "query_id").select("*", *key),
        5, 0.0, block_rows=16)
    got = {(r.query_id, r.chunk_id): r["rank"] for r in retrieval.topk_per_query(parts, 5, 0.0).collect()}
    assert got == brute_top(index, queries, 5, 0.0)


def test_zero_vector_matches_nothing(spark):
    data = np.zeros((2, 4), dtype="float32")
    data[1] = 1
    found = retrieval.vector_search(frame(spark, data, "chunk_id"), frame(spark, data, "query_id"), 5, -1.0)
    assert [(r.query_id, r.chunk_id) for r in found.collect()] == [(1, 1)]


def clustered(seed, n, centres, dim, spread):
    rnd = np.random.default_rng(seed)
    middle = rnd.standard_normal((centres, dim))
    return (middle[rnd.integers(0, centres, n)] + spread * rnd.standard_normal((n, dim))).astype("float32")


def found_pairs(df):
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


def test_approximate_results_are_exact_ones_with_good_recall(spark):
    index, queries = clustered(11, 3000, 60, 32, 0.3), clustered(11, 60, 60, 32, 0.2)
    a, b = frame(spark, index, "chunk_id"), frame(spark, queries, "query_id")
    exact = found_pairs(retrieval.vector_search(a, b, 20, 0.7))
    probing = retrieval.fit_probing(a, b, 20, 0.7, cell_rows=200)
    assert probing != retrieval.PROBINGS[-1]
    near = found_pairs(retrieval.approx_search(a, b, 20, 0.7, probing, cell_rows=200))
    assert all(near[k] == exact[k] for k in set(near) & set(exact))
    assert len(set(near) & set(exact)) >= 0.9 * len(exact)
    everything = retrieval.PROBINGS[-1]
    assert found_pairs(retrieval.approx_search(a, b, 20, 0.7, everything, cell_rows=200)) == exact


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_approximate_search_has_recall_at_every_size(spark, sf):
    from plumbline.plans import retrieval_queries

    t = Inputs(spark, SF.replace("sf0.001", sf))
    data = {r.chunk_id: r.embedding for r in t.vectors.collect()}
    ids = sorted(data)
    rows = np.array([data[i] for i in ids], "float64")
    best = brute_top(rows, rows, 6, 0.2)  # the first of each is the vector itself
    near = {(ids[q], ids[c]) for q, c in best if q != c}
    found = {(r.query_id, r.chunk_id) for r in retrieval_queries.approx_search(t).collect()}
    assert len(found & near) >= 0.9 * len(near)
    assert retrieval_queries.PROBING.scored <= 0.1  # of all pairs


def test_measured_probing_on_clusters(spark):
    """20,000 vectors in cells of 500: a query visits part of the cells, and scores a tenth of what lies there."""
    index = clustered(7, 20_000, 200, 32, 0.35)
    a = frame(spark, index, "chunk_id")
    b = frame(spark, index[::50], "query_id")
    options = dict(k=5, min_score=0.7, cell_rows=500)
    probing = retrieval.fit_probing(a, b, **options)
    assert probing.scored * probing.cells <= 0.1 and probing.cells < 1
    exact = set(found_pairs(retrieval.vector_search(a, b, 5, 0.7)))
    found = set(found_pairs(retrieval.approx_search(a, b, 5, 0.7, probing, cell_rows=500)))
    assert len(found & exact) >= 0.9 * len(exact)


def test_approximate_search_plans_without_jobs_and_deals_copies(spark):
    data = vectors(3, 900, copies=300)
    a, b = frame(spark, data, "chunk_id"), frame(spark, data[:40], "query_id")
    spark.sparkContext.setJobGroup("planning", "planning")
    planned = retrieval.approx_search(a, b, 3, 0.5, retrieval.PROBINGS[-1], cell_rows=50, skip_self=True)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    best = {(q, c) for q, c in brute_top(data, data[:40], 901, 0.5) if q != c}
    got = planned.collect()
    assert {(r.query_id, r.chunk_id) for r in got} <= best and max(r.rank for r in got) == 3


def test_probes_come_in_the_order_of_what_they_cross():
    rnd = np.random.default_rng(2)
    for bits in (1, 2, 5, 8):
        margins = rnd.standard_normal(bits)
        own = [m >= 0 for m in margins]
        cost = {c: sum(abs(m) for i, m in enumerate(margins) if bool(c >> i & 1) != own[i]) for c in range(2**bits)}
        assert retrieval.probe_sequence(margins, 2**bits) == sorted(cost, key=cost.get)
        assert retrieval.probe_sequence(margins, 3) == sorted(cost, key=cost.get)[:3]


@pytest.mark.parametrize("unit", ["character", "token"])
def test_chunks_rebuild_the_text(spark, unit):
    words = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 7, 100, 333)]
    df = spark.createDataFrame(list(enumerate(words)), "id int, text string")
    rows = retrieval.chunk(df, size=50, overlap=5, unit=unit).orderBy("id", "chunk_index").collect()
    for i, text in enumerate(words):
        parts = [r.text for r in rows if r.id == i]
        if unit == "token":
            tokens = [p.split() for p in parts]
            assert sum((p if n == 0 else p[5:] for n, p in enumerate(tokens)), []) == text.split()
        else:
            assert "".join(p if n == 0 else p[5:] for n, p in enumerate(parts)) == text


def test_embeddings_have_unit_length(spark):
    df = spark.createDataFrame([(1, "wall width corridor"), (2, "door height"), (3, "")], "id int, text string")
    rows = retrieval.embed_chunks(df, dim=64).orderBy("id").collect()
    assert all(len(r.embedding) == 64 for r in rows)
    assert [round(float(np.linalg.norm(r.embedding)), 5) for r in rows] == [1.0, 1.0, 0.0]
    custom = retrieval.embed_chunks(df, embedder=lambda c: F.array(F.length(c).cast("float")))
    assert [r.embedding for r in custom.orderBy("id").collect()] == [[19.0], [11.0], [0.0]]


def test_retrieved_violations_are_rule_violations(spark):
    from plumbline.plans import retrieval_queries

    t = Inputs(spark, SF)
    found = {(r.element_id, r.rule_id) for r in retrieval_queries.retrieve_and_check(t).collect()}
    every = {(r.element_id, r.rule_id) for r in rules.evaluate_rules(t.placed(), rules.active_rules(t.rules, None)).collect()}
    assert found and found <= every


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    from plumbline.operators import vector_store

    path = tmp_path / "store"
    files = lambda: {str(f) for f in path.glob("vectors/*/*/*.parquet")}
    make = lambda ids, state: spark.createDataFrame([(i, state, [float(i or 0), 1.0]) for i in ids], "chunk_id long, state string, embedding array<float>")
    with pytest.raises(ValueError, match="no published"):
        vector_store.read_vectors(spark, str(path))
    assert vector_store.upsert(make(range(2000), "old"), 0, str(path), 64)
    first = files()
    changed = [7, 11, 500, 3000, 3001]
    assert vector_store.upsert(make(changed, "new").unionByName(make([7, None], "a")), 1, str(path), 64)
    rows = {r.chunk_id: r for r in vector_store.read_vectors(spark, str(path)).collect()}
    assert len(rows) == 2002 and {i for i, r in rows.items() if r.state == "new"} == set(changed)
    touched = {r.bucket for i, r in rows.items() if i in changed}
    assert first <= files() and {int(f.split("bucket=")[1].split("/")[0]) for f in files() - first} == touched and len(touched) < 10
    before = files()
    assert not vector_store.upsert(make(range(2000), "again"), 1, str(path), 64) and files() == before  # a replay
    with pytest.raises(ValueError, match="64 buckets"):
        vector_store.upsert(make([1], "x"), 2, str(path), 32)
    # an attempt that was not published is not seen
    spark.range(3).selectExpr("id AS chunk_id", "'lost' AS state", "array(0f) AS embedding", "0 AS bucket").write.partitionBy("bucket").parquet(f"{path}/vectors/attempt=lost")
    assert vector_store.read_vectors(spark, str(path)).filter("state = 'lost'").isEmpty()


def test_a_model_is_called_once_a_text(spark):
    """No filter carries the embedding below the aggregate of the elements' texts."""
    elements = spark.createDataFrame(
        [(str(i), ["Wall", "Door"][i % 2], "office", 100.0, 100.0) for i in range(400)],
        "element_id string, element_type string, building_type string, width_mm double, height_mm double")
    catalogue = spark.createDataFrame(
        [(1, "R1", "min_width", "wall", None, 900.0, "critical", "s"), (2, "R2", "max_height", "door", ["office"], 50.0, "info", "s")],
        "id long, rule_id string, rule_type string, geometry_type string, building_types array<string>, value_mm double, severity string, code_reference string")
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def model(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [1.0, 1.0] if "wall" in t else [1.0, 0.0])

    chunks = catalogue.select(F.col("id").alias("chunk_id"), "rule_id", "geometry_type", "building_types", F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>").alias("embedding"))
    out = retrieval.retrieve_and_check(elements, chunks, catalogue, model, min_score=0.1)
    assert {(r.element_id, r.rule_id) for r in out.collect()} == {(str(i), ["R1", "R2"][i % 2]) for i in range(400)}
    assert seen.value == 2
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]


def test_weights_equal_plain_python(spark):
    import hashlib
    import re
    from collections import Counter

    texts = ["Wall width, WALL", "", None, "9 doors - door 9 šířka", "  ", "a " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:12], 16) % 64
    split = {i: Counter(place(w) for w in re.findall(r"[^\W_]+", t.lower())) for i, t in enumerate(texts) if t is not None}
    idf = {p: math.log((len(split) + 1) / (sum(p in c for c in split.values()) + 1)) for c in split.values() for p in c}
    model = retrieval.fit_embedder(df, dim=64)
    for r in model.transform(model.weights(df)).collect():
        raw = {p: n * idf[p] for p, n in split.get(r.id, {}).items() if idf[p]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert [w.place for w in r.weights] == sorted(raw)
        assert all(abs(w.weight - raw[w.place] / norm) < 1e-12 for w in r.weights)
        assert len(r.embedding) == 64 and all(abs(v - raw.get(i, 0) / (norm or 1)) < 1e-6 for i, v in enumerate(r.embedding))


def test_pages_and_files(spark, tmp_path):
    (tmp_path / "code.txt").write_text("page one\fpage two", encoding="utf-8")
    rows = documents.read_documents(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [(r.source_document, r.page_number, r.text) for r in rows] == [("code.txt", 1, "page one"), ("code.txt", 2, "page two")]


# ---------------------------------------------------------------- graph

def test_cycle_in_containment_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b", "CONTAINS"), ("b", "a", "CONTAINS")], "src string, dst string, rel string")
    with pytest.raises(ValueError):
        graph.containment_closure(edges)


def test_reachability_matches_brute_force(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(0, i) for i in range(1, 20)]
    edges = spark.createDataFrame([(f"R{a}", f"R{b}", "CONNECTS_TO") for a, b in pairs], "src string, dst string, rel string")
    nodes = spark.createDataFrame([(f"R{i}", "Room", "") for i in range(60)], "id string, kind string, name string")
    hops, level = {5: 0}, [5]
    while level:
        level = [n for n in {b for a, b in pairs + [(b, a) for a, b in pairs] if a in level} if n not in hops]
        hops |= {n: hops_of + 1 for n in level for hops_of in [max(hops.values())]}
    got = {r.id: r.hops for r in graph.reachability(nodes, edges, nodes.filter("id = 'R5'").select("id")).collect()}
    assert got == {f"R{i}": hops.get(i) for i in range(60)}


def test_reachability_and_containment_have_no_depth_limit(spark):
    n = 40
    way = spark.createDataFrame([(f"R{i}", f"R{i + 1}", "CONNECTS_TO") for i in range(n)], "src string, dst string, rel string")
    nodes = spark.createDataFrame([(f"R{i}", "Room", "") for i in range(n + 1)], "id string, kind string, name string")
    got = {r.id: r.hops for r in graph.reachability(nodes, way, nodes.filter("id = 'R0'").select("id")).collect()}
    assert got == {f"R{i}": i for i in range(n + 1)}
    below = way.withColumn("rel", F.lit("CONTAINS"))
    assert graph.containment_closure(below).agg({"depth": "max"}).first()[0] == n


def test_containment_path_keeps_elements_on_floors_and_buildings(spark):
    nodes = spark.createDataFrame([("B", "Building", ""), ("F", "Floor", ""), ("R", "Room", ""), ("W1", "Wall", ""), ("W2", "Wall", ""),
                                   ("D", "Door", ""), ("N", "Window", "")], "id string, kind string, name string")
    edges = spark.createDataFrame([("B", "F", "CONTAINS"), ("F", "R", "CONTAINS"), ("R", "D", "CONTAINS"), ("F", "W1", "CONTAINS"),
                                   ("B", "W2", "CONTAINS")], "src string, dst string, rel string")
    got = {r.id: (r.room, r.floor, r.building) for r in graph.containment_path(nodes, edges).collect()}
    assert got == {"D": ("R", "F", "B"), "W1": (None, "F", "B"), "W2": (None, None, "B"), "N": (None, None, None)}


def test_checks_of_large_orders_keep_their_keys(spark):
    from plumbline.plans.views import VIEWS

    t = Inputs(spark, SF)
    lines = t.lineitem.limit(50).withColumn("l_orderkey", F.col("l_orderkey") + 10**12).withColumn("l_partkey", F.col("l_partkey") + 10**9)
    orders = lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(t.orders.drop("o_orderkey").limit(1))
    rows = spark.sql(VIEWS["project_elements"], lineitem=lines, orders=orders)
    assert rows.select("id").distinct().count() == 50


def test_analysis_labels_checks_without_a_project(spark):
    checks = spark.createDataFrame([("a", 1, False), ("b", 9, True)], "id string, project_id long, is_compliant boolean")
    results = spark.createDataFrame([("a", "critical")], "check_id string, severity string")
    projects = spark.createDataFrame([(1, "office")], "id long, building_type string")
    rows = {(r.building_type, r.project_id) for r in reports.project_analysis(checks, results, projects).collect()}
    assert rows == {("office", 1), ("unknown", 9), ("office", None), ("unknown", None), (None, None)}


def test_persist_publishes_both_tables_once(spark, monkeypatch):
    from plumbline.operators import persist
    from plumbline.plans import table_queries
    from plumbline.session import scratch_path

    t = Inputs(spark, SF)
    path, stored_rules = scratch_path(spark, "twice"), table_queries._rules_with_builtin(t)
    checked = t.checked().drop("id")
    broken = checked.withColumn("violations", F.when(F.rand() < 2, F.raise_error(F.lit("lost")).cast(checked.schema["violations"].dataType)))
    with pytest.raises(Exception, match="lost"):
        persist.persist(broken, stored_rules, path, 3)
    for _ in range(2):
        persist.persist(checked, stored_rules, path, 3)
    persist.persist(checked.limit(10), stored_rules, path, 4)
    checks = persist.read_stored(spark, path, "compliance_checks")
    assert checks.count() == checked.count() + 10
    assert checks.select("id").distinct().count() == checks.count()
    results = persist.read_stored(spark, path, "check_results")
    assert results.join(checks.select(F.col("id").alias("check_id")), "check_id", "left_anti").isEmpty()
    assert results.filter("batch_id = 3").count() == checked.select(F.explode("violations")).count()


def test_unknown_kind_or_relation(spark):
    with pytest.raises(ValueError):
        graph.build_graph([("Tower", None)])
    with pytest.raises(ValueError):
        graph.build_graph([], {"NEAR": None})
