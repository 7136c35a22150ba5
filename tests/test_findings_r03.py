"""Small cases for the findings of round 3; each failed before."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF
from plumbline.operators import enrich, retrieval, rules
from plumbline.plans import check_queries  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES, Inputs
from plumbline.plans.views import TABLES
from plumbline.streaming import state


def test_type_of_a_nameless_room_in_sql(spark):
    """of overlapping rooms the smallest id gives its type, also when it has none."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    again = "SELECT * REPLACE (s_suppkey + i * 250 AS s_suppkey) FROM (SELECT * FROM read_parquet('{0}/supplier.parquet') WHERE s_suppkey < 250), range(5) r(i)"
    con.execute(f"CREATE OR REPLACE VIEW supplier AS {again.format(SF)}")
    t = Inputs(spark, SF)
    few = spark.read.parquet(f"{SF}/supplier.parquet").filter("s_suppkey < 250")
    keys = few.select(*[c for c in few.columns if c != "s_suppkey"], F.explode(F.sequence("s_suppkey", F.col("s_suppkey") + 1000, F.lit(250))).alias("s_suppkey"))
    t.supplier = keys
    got = enrich.join_rooms(t.raw_elements, t.rooms).select("element_id", "room_id", "room_type").collect()
    want = con.execute(ORACLES["join_rooms"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(room is not None and kind is None for _, room, kind in want)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def below(lines, number):
    """The lines of a plan below one of them."""
    depth = re.search(r"[A-Za-z]", lines[number]).start()
    after = lines[number + 1:]
    end = next((i for i, line in enumerate(after) if line.strip() and re.search(r"[A-Za-z]", line).start() <= depth), len(after))
    return after[:end]


def test_measures_are_spelt_once_an_element(spark):
    """numbers turn into text below the join of elements and rules, not once a violation."""
    t = Inputs(spark, SF)
    lines = optimized(rules.evaluate_rules(t.placed(), rules.active_rules(t.part_rules, language=None)))
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert not any("regexp_replace" in line for line in lines[:join]) and any("regexp_replace" in line for line in lines[join:])


def test_every_kind_of_rule_judges_its_own_measure(spark):
    """also measures that are missing or not a number, and kinds registered later."""
    rules.register_evaluator("no_height", "height_mm", lambda value, limit: value.isNull() & (limit > 0))
    try:
        elements = spark.createDataFrame(
            [("a", "Wall", "Office", 900.0, None), ("b", "wall", None, None, 3000.0), ("c", "WALL", "x", float("nan"), float("nan"))],
            "element_id string, element_type string, building_type string, width_mm double, height_mm double")
        kinds = [(f"{kind}{i}", kind, "wall", scope, 1000.0, "info", "s") for kind in ("min_width", "max_height", "no_height", "other")
                 for i, scope in enumerate((None, ["office", "office"]))]
        found = rules.evaluate_rules(elements, spark.createDataFrame(
            kinds, "rule_id string, rule_type string, geometry_type string, building_types array<string>, value_mm double, severity string, code_reference string"))
        assert sorted((r.element_id, r.rule_id, r.message, r.actual_value) for r in found.collect()) == [
            ("a", "min_width0", "min_width 1000.0mm not met: 900.0mm", 900.0), ("a", "min_width1", "min_width 1000.0mm not met: 900.0mm", 900.0),
            ("a", "no_height0", None, None), ("a", "no_height1", None, None),
            ("b", "max_height0", "max_height 1000.0mm not met: 3000.0mm", 3000.0),
        ]
    finally:
        del rules.EVALUATORS["no_height"]


def test_elements_travel_once_to_their_project(spark):
    """F8: orders meet projects before elements meet orders."""
    t = Inputs(spark, SF)
    lines = optimized(t.placed())
    outer = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert not any("l_orderkey" in line for line in below(lines, outer))
    own = {(r.element_id, r.project_id, r.building_type) for r in t.placed().collect()}
    kinds = {r.id: r.building_type for r in t.projects.collect()}
    assert own == {(r.element_id, r.project_id, kinds.get(r.project_id) or "Residential") for r in t.project_elements.collect()}


def test_built_in_rule_judges_before_any_join(spark):
    """of the elements only violating ones meet their order, and none its project, for the built-in rule."""
    lines = optimized(QUERIES["all_violations"](spark, SF))
    joins = [i for i, line in enumerate(lines) if "Join Inner" in line]
    built_in = below(lines, joins[0])
    assert any("Filter" in line and "size(" in line and "l_quantity" in line for line in built_in)
    assert sum("c_custkey" in line and "Relation" in line for line in lines) == 1


class FakeState:
    """State of one key that counts its calls."""

    def __init__(self):
        self.values, self.map, self.calls, self.timers = {}, {}, 0, []

    def getValueState(self, name, schema):
        state = self

        class Value:
            def exists(self):
                state.calls += 1
                return name in state.values

            def get(self):
                state.calls += 1
                return state.values.get(name)

            def update(self, value):
                state.calls += 1
                state.values[name] = value

            def clear(self):
                state.calls += 1
                state.values.pop(name, None)

        return Value()

    def getMapState(self, name, key, value):
        state = self

        class Map:
            def getValue(self, key):
                state.calls += 1
                return state.map[key]

            def updateValue(self, key, value):
                state.calls += 1
                state.map[key] = value

            def removeKey(self, key):
                state.calls += 1
                del state.map[key]

            def clear(self):
                state.calls += 1
                state.map.clear()

        return Map()

    def registerTimer(self, ms):
        self.timers.append(ms)


def told_by(fake, frames, marks, seconds=60):
    """What the processor tells of frames of ``(t, id, ok)`` rows that come at watermark 0, then at each mark."""
    processor = state._HistoryProcessor(seconds * 1000)
    processor.init(fake)
    mark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    list(processor.handleInputRows((7, True), iter(pd.DataFrame(f, columns=["t", "id", "is_compliant"]) for f in frames), mark(0)))
    out = []
    for ms in marks:
        for part in processor.handleExpiredTimer((7, True), mark(ms), None):
            out += list(zip(part["id"], part["transition"]))
    return out


def test_history_state_calls_follow_keys_and_not_slices():
    """300 rows of 300 slices lie in one entry."""
    fake = FakeState()
    rows = [(i * 60_000_000, i, i % 2 == 0) for i in range(300)]
    told = told_by(fake, [rows], [300 * 60_000 + 1])
    assert told == [(i, "first" if i == 0 else "fixed" if i % 2 == 0 else "regressed") for i in range(300)]
    assert fake.calls < 20 and not fake.map and set(fake.values) == {"last"}


def test_history_entries_that_overlap_are_told_in_order(monkeypatch):
    """frames over the same time, told in three parts, with few rows merged at a time; ties go by id."""
    monkeypatch.setattr(state, "ENTRY_ROWS", 8, raising=False)
    monkeypatch.setattr(state, "MERGED_ROWS", 16, raising=False)
    rnd = random.Random(3)
    rows = [(rnd.randrange(2000) * 1_000_000, i, rnd.random() < 0.5) for i in range(1500)]
    fake = FakeState()
    told = told_by(fake, [rows[i:i + 100] for i in range(0, len(rows), 100)], [400_000, 401_000, 2_001_000], seconds=1)
    want, last = [], None
    for _, number, ok in sorted(rows):
        if ok != last:
            want.append((number, "first" if last is None else "fixed" if ok else "regressed"))
        last = ok
    assert told == want and not fake.map


def block(n, dim, seed=4):
    rnd = np.random.default_rng(seed)
    vectors = rnd.normal(size=(n, dim)).astype("float32")
    return vectors, pa.table({"chunk_id": pa.array(range(n)), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scores_of_a_block_are_held_by_tiles(spark):
    """memory beyond the vectors does not follow the chunks of a block."""
    _, chunks = block(60_000, 4)
    asked = retrieval._matrix(chunks["embedding"])[:300]
    assert peak_mb(lambda: retrieval._best(pd.Series(range(300)), asked, chunks, 5, 0.9, True)) < 80


def test_codes_of_a_block_are_compared_by_tiles_in_single_precision(spark):
    """and what lies at the cut is decided in double precision, ties included."""
    vectors, chunks = block(20_000, 8)
    probing = retrieval.Probing(1.0, 0.1, 32)
    asked = retrieval._matrix(chunks["embedding"])[:200]
    assert peak_mb(lambda: retrieval._probed(pd.Series(range(200)), asked, chunks, 5, 0.5, True, probing=probing)) < 60

    vectors, _ = block(900, 16)
    vectors[600:] = vectors[:300]  # copies tie
    vectors[5], vectors[6, 2] = 0, np.nan
    chunks = pa.table({"chunk_id": pa.array(range(900)), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    unit = retrieval._matrix(chunks["embedding"])
    margins = unit @ retrieval._planes(64, 16)
    near = np.round(margins @ np.where(margins >= 0, 1.0, -1.0).T, retrieval.SCORE_DIGITS)
    want = set()
    for q in range(900):
        those = [c for c in range(900) if c != q and not {5, 6} & {c, q}]
        cut = sorted((near[q, c] for c in those), reverse=True)[:90] or [0.0]
        inside = [(-round(float(unit[q] @ unit[c]), 6), c) for c in those if near[q, c] >= cut[-1]]
        want |= {(q, c) for score, c in sorted(inside)[:7] if -score >= 0.2}
    found = retrieval._probed(pd.Series(range(900)), unit, chunks, 7, 0.2, True, probing=retrieval.Probing(1.0, 0.1, 64))
    assert set(zip(found["query_id"], found["chunk_id"])) == want


def test_batches_are_picked_at_the_scan(spark, monkeypatch):
    """a batch reads its lines by the stored column; no text is made for the others."""
    plans = []
    store = check_queries.policy.store_requests
    monkeypatch.setattr(check_queries.policy, "store_requests", lambda df, *rest: plans.append("\n".join(optimized(df))) or store(df, *rest))
    assert QUERIES["error_policy_fail"](spark, SF).count() > 0
    assert len(plans) == 7 and all("(l_linenumber" in p and "split(" not in p for p in plans)
