"""Golden cases of validation, the built-in rule, extraction and the scalar functions."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.text import element_type, float_text, floor_number, iso_stamp
from plumbline.functions.units import feet_to_mm, mm_to_feet, sqft_to_sqm
from plumbline.operators import corridor, extract, integrity, reports, requests

# element_type, width, room, occupancy, compliant (None = rejected), required
GOLDEN = [
    ("Wall", 200, "Corridor", None, False, 1200.0),
    ("Wall", 900, "Corridor", 150, False, 1200.0),
    ("Wall", 1200, "Corridor", 200, True, None),
    ("Wall", 1200, "Corridor", 201, False, 1500.0),
    ("Wall", 1500, "Corridor", 201, True, None),
    ("CORRIDOR", 1199.9, "Corridor", 0, False, 1200.0),
    ("Wall", 200, "corridor", None, True, None),
    ("Walls", 200, "Corridor", None, True, None),
    ("Door", 200, "Corridor", None, True, None),
    ("Wall", 200, "no context", None, True, None),
    ("Wall", None, "Corridor", None, None, None),
    (None, 200, "Corridor", None, None, None),
    ("Wall", "200", "Corridor", None, False, 1200.0),
    ("Wall", 200, "Corridor", 250.5, None, None),
    ("wall", 200, "Corridor", None, False, 1200.0),
]


def request(kind, width, room, occupancy):
    context = None if room == "no context" else {"room_type": room, "occupancy": occupancy}
    return json.dumps({"element_type": kind, "properties": {"width_mm": width}, "context": context})


def test_golden_table(spark):
    rows = [(i, request(*case[:4])) for i, case in enumerate(GOLDEN)]
    valid, rejected = requests.validate(spark.createDataFrame(rows, "id int, json string"))
    checked = {r.id: r for r in corridor.check_corridor(valid).collect()}
    bad = {r.id: r.reasons for r in rejected.collect()}
    assert set(checked) | set(bad) == set(range(len(GOLDEN))) and not set(checked) & set(bad)
    for i, (kind, width, _, _, compliant, required) in enumerate(GOLDEN):
        if compliant is None:
            assert i in bad
            continue
        row = checked[i]
        assert row.compliant is compliant
        assert [v.required_value for v in row.violations] == ([] if compliant else [required])
        if not compliant:
            assert row.violations[0].message == (
                f"Corridor width ({float(width)}mm) is less than minimum {int(required)}mm required by ČSN 73 0802"
            )
            assert row.recommendations == [f"Increase {kind.lower()} spacing to meet minimum requirements"]
    assert bad[10] == ["properties.width_mm.missing"]
    assert bad[11] == ["element_type.missing"]
    assert bad[13] == ["context.occupancy.type"]


@pytest.mark.parametrize("text, reasons", [
    ('{"element_type": "Wall", "properties": {"width_mm": 1}', ["json.invalid"]),
    ("[1]", ["json.invalid"]),
    (None, ["json.invalid"]),
    ("{}", ["properties.missing", "element_type.missing"]),
    ('{"element_type": 5, "properties": {"width_mm": 1}}', ["element_type.type"]),
    ('{"element_type": "5", "properties": {"width_mm": 1}}', []),
    ('{"element_type": "Wall", "properties": 3}', ["properties.type"]),
    ('{"element_type": "Wall", "properties": {"width_mm": 1}, "context": [1]}', ["context.type"]),
    ('{"element_type": "Wall", "properties": {"width_mm": "wide"}}', ["properties.width_mm.type"]),
    ('{"element_type": "Wall", "properties": {"width_mm": true}}', []),
    ('{"element_type": "Wall", "properties": {"width_mm": "true"}}', ["properties.width_mm.type"]),
    ('{"element_type": "Wall", "properties": {"width_mm": 1, "function": 7}}', ["properties.function.type"]),
    ('{"element_type": "Wall", "properties": {"width_mm": 1}, "context": {"occupancy": "12"}}', []),
    ('{"element_type": "Wall", "properties": {"width_mm": 1}, "context": {"occupancy": 12.0}}', []),
    ('{"element_type": "Wall", "properties": {"width_mm": 1}, "context": {"floor_level": "a"}}',
     ["context.floor_level.type"]),
    ('{"element_type": "Wall", "properties": {"width_mm": NaN, "height_mm": -Infinity}}', []),
    ('{"element_type": "NaN", "properties": {"width_mm": 1, "width_mm": 2}}', []),
    ('{"element_type": "Wall", "properties": {"width_mm": 1, "width_mm": "x"}}', ["properties.width_mm.type"]),
    ('{"element_type": null, "properties": {}, "context": {}}', ["element_type.missing", "properties.width_mm.missing"]),
    ('{"element_type": "Wall", "properties": {"width_mm": {"a": 1}}}', ["properties.width_mm.type"]),
    ('"text"', ["json.invalid"]), ("null", ["json.invalid"]), ("", ["json.invalid"]),
    ('{"element_type": "Wall", "properties": {"width_mm": 1e400}}', []),  # infinite, as the service reads it
])
def test_rejection_reasons(spark, text, reasons):
    row = requests.read_check_requests(spark.createDataFrame([(text,)], "json string")).first()
    assert row.reasons == reasons


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([(request(*GOLDEN[0][:4]),)], "json string")
    plan = requests.read_check_requests(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1 and "from_json" not in plan


def test_error_policy_fail_aborts(spark):
    df = spark.createDataFrame([(request(*GOLDEN[0][:4]),), ("{}",)], "json string")
    strict, rest = requests.apply_error_policy(df, "fail")
    assert rest is None
    for read in (strict.collect, strict.count, strict.select("properties.width_mm").collect):
        with pytest.raises(Exception, match="rejected request"):
            read()
    assert requests.apply_error_policy(df.limit(1), "fail")[0].count() == 1
    valid, rejected = requests.apply_error_policy(df, "isolate")
    assert (valid.count(), rejected.count()) == (1, 1)
    with pytest.raises(ValueError):
        requests.apply_error_policy(df, "ignore")


def test_response_json(spark):
    df = spark.createDataFrame([(request(*GOLDEN[0][:4]),)], "json string")
    checked = corridor.check_corridor(requests.validate(df)[0], F.lit("2024-05-01 10:00:00.250000").cast("timestamp"))
    body = json.loads(requests.to_response_json(checked).first().json)
    assert list(body) == ["compliant", "violations", "recommendations", "checked_at"]
    assert body["checked_at"] == "2024-05-01T10:00:00.250000Z"
    assert body["violations"][0]["confidence_score"] == 0.98


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name, floor", [
    (None, 0), ("7", 7), (" 7 ", 7), ("-1", -1), ("+3", 3), ("1.5", 1), ("Level 12", 1), ("Level 21", 1), ("Level 2", 2),
    ("Level 3", 0), ("Ground", 1), ("GROUND floor", 1), ("Second floor", 2), ("99999999999", 0), ("", 0), ("\t8\n", 8),
])
def test_floor_number(spark, name, floor):
    assert one(spark, floor_number(F.lit(name).cast("string"), F.lit(True))) == floor


def test_floor_number_without_parameter(spark):
    assert one(spark, floor_number(F.lit("7"), F.lit(False))) is None


def test_units(spark):
    assert one(spark, feet_to_mm(F.lit(1.0))) == 304.8
    assert one(spark, mm_to_feet(F.lit(304.8))) == 1.0
    assert one(spark, sqft_to_sqm(F.lit(100.0))) == pytest.approx(9.2903)


def test_float_text_prints_like_the_service(spark):
    values = [
        0.0, -0.0, 1.0, 200.0, 0.001, 0.0001, 0.00012345678901234567, 1e-5, 1.5e-7, 1e7, 12345678.5, 1e15,
        123456789012345.6, 1e16, 1.5e22, -1e7, -2.5e-9, float("nan"), float("inf"), float("-inf"), 1e100, 114.30000000000001,
    ]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.t for r in df.select(float_text(F.col("x")).alias("t")).collect()] == [repr(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1e6, allow_nan=False), min_size=1, max_size=50))
def test_feet_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    worst = df.select(F.max(F.abs(mm_to_feet(feet_to_mm(F.col("x"))) - F.col("x"))).alias("d")).first().d
    assert worst <= 1e-9


def test_widening_and_occupancy_are_monotone(spark):
    grid = spark.range(0, 2000, 50).select(F.col("id").cast("double").alias("w")).join(
        spark.range(0, 400, 40).select(F.col("id").cast("int").alias("o")), F.col("w") >= -F.col("o")
    )
    context = F.struct(F.lit("Corridor").alias("room_type"), F.col("o").alias("occupancy"))
    n = F.size(corridor.corridor_violations(F.lit("Wall"), F.col("w"), context))
    rows = {(r.w, r.o): r.n for r in grid.select("w", "o", n.alias("n")).collect()}
    assert all(rows[w + 50, o] <= n for (w, o), n in rows.items() if (w + 50, o) in rows)
    assert all(rows[w, o + 40] >= n for (w, o), n in rows.items() if (w, o + 40) in rows)


def test_nan_width_is_compliant(spark):
    context = F.struct(F.lit("Corridor").alias("room_type"), F.lit(1).alias("occupancy"))
    assert one(spark, F.size(corridor.corridor_violations(F.lit("Wall"), F.lit(float("nan")), context))) == 0


def test_extract_by_kind(spark):
    rows = [
        ("Walls", "wall", 1.0, None, "Exterior", "F", {"Width": 9.0}),
        ("Doors", "family", 1.0, 2.0, "x", "Single", {"Šířka": 3.0, "Výška": 7.0}),
        ("Doors", "family", None, None, None, "Single", {"Width": 4.0, "Šířka": 3.0}),
        (None, "other", 1.0, 2.0, "x", "F", {"Width": 9.0}),
    ]
    ddl = ("category string, kind string, wall_width double, wall_height double, wall_function string, "
           "family_name string, params map<string,double>")
    out = extract.extract_properties(spark.createDataFrame(rows, ddl)).collect()
    assert [tuple(r.properties) for r in out] == [
        (304.8, None, None, "Exterior"), (3 * 304.8, 7 * 304.8, None, "Single"),
        (4 * 304.8, None, None, "Single"), (None, None, None, None),
    ]
    assert [r.element_type for r in out] == ["Walls", "Doors", "Doors", "Unknown"]


def test_element_type_normaliser(spark):
    df = spark.createDataFrame([("Walls",), ("Stairs",), ("DOOR",), (None,)], "c string")
    folded = [r.x for r in df.select(element_type(F.col("c"), normalise=True).alias("x")).collect()]
    assert folded == ["wall", "stairs", "door", "unknown"]


def test_relevance_and_trigger(spark):
    rows = [("modified", c) for c in ("Wall", "Door", "Window", "Roof", None)] + [("added", "Wall")]
    df = spark.createDataFrame(rows, "change_type string, category string")
    assert extract.relevant(df).count() == 4
    assert [r.category for r in extract.triggered(df).collect()] == ["Wall", "Door"]
    assert extract.triggered(df, enabled=False).count() == 0


@pytest.mark.parametrize("sizes, message", [
    ([1, 1, 0], "Checked 3 element(s).\nFound 2 violation(s). See log for details."),
    ([0, 0, 0], "Checked 3 element(s).\nAll elements are compliant!"),
    ([], "Please select at least one element to check."),
])
def test_batch_summary(spark, sizes, message):
    rows = [({"a": 1}, [1] * n) for n in sizes]
    df = spark.createDataFrame(rows, "context map<string,int>, violations array<int>")
    assert reports.batch_summary(df).first().message == message


def test_stamp_drops_zero_fraction(spark):
    assert one(spark, iso_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05Z"


def test_defaults(spark):
    df = spark.createDataFrame([(1, None, True)], "id long, is_active boolean, is_superuser boolean")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    row = integrity.apply_defaults(df, "users", now).first()
    assert (row.is_active, row.is_superuser, str(row.created_at)) == (True, True, "2024-01-01 00:00:00")
    later = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    again = integrity.apply_defaults(integrity.apply_defaults(df, "users", now), "users", later, update=True).first()
    assert (again.created_at.year, again.updated_at.year) == (2024, 2025)


def test_schemas_parse():
    for name in schemas.TABLES:
        fields = {f.name for f in schemas.table_schema(name).fields}
        assert set(schemas.NOT_NULL[name]) <= fields and set(schemas.DEFAULTS[name]) <= fields
