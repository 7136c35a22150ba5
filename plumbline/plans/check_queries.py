"""Queries over records: reading, validation, extraction, the built-in rule and its outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import element_type, first_param, floor_number, iso_stamp
from plumbline.functions.units import feet_to_mm, mm_to_feet, sqft_to_sqm
from plumbline.operators import corridor, enrich, extract, integrity, reports, requests, rules
from plumbline.plans.registry import Inputs, query
from plumbline.plans.views import VIEWS
from plumbline.session import scratch_path
from plumbline.streaming import policy

_TYPED = """
    WITH RECURSIVE parsed AS (
        SELECT element_id, CASE WHEN json_valid(json) THEN json END AS j FROM {request_texts}
    ), kinds AS (
        SELECT *, json_type(j, '$.element_type') AS k_type, json_type(j, '$.properties') AS k_prop,
               json_type(j, '$.properties.width_mm') AS k_width, json_type(j, '$.properties.height_mm') AS k_height,
               json_type(j, '$.context') AS k_context, json_type(j, '$.context.occupancy') AS k_occ,
               json_extract_string(j, '$.element_type') AS s_type,
               TRY_CAST(json_extract_string(j, '$.properties.width_mm') AS DOUBLE) AS n_width,
               TRY_CAST(json_extract_string(j, '$.properties.height_mm') AS DOUBLE) AS n_height,
               TRY_CAST(json_extract_string(j, '$.context.occupancy') AS DOUBLE) AS n_occ,
               json_extract_string(j, '$.context.room_type') AS s_room
        FROM parsed
    ), faults AS (
        SELECT *, concat_ws(',',
            CASE WHEN j IS NULL THEN 'json.invalid' END,
            CASE WHEN j IS NOT NULL AND coalesce(k_prop, 'NULL') = 'NULL' THEN 'properties.missing' END,
            CASE WHEN j IS NOT NULL AND coalesce(k_type, 'NULL') = 'NULL' THEN 'element_type.missing'
                 WHEN k_type <> 'VARCHAR' THEN 'element_type.type' END,
            CASE WHEN k_prop = 'OBJECT' AND coalesce(k_width, 'NULL') = 'NULL' THEN 'properties.width_mm.missing'
                 WHEN k_width IS NOT NULL AND n_width IS NULL THEN 'properties.width_mm.type' END,
            CASE WHEN coalesce(k_occ, 'NULL') <> 'NULL' AND (n_occ IS NULL OR n_occ <> floor(n_occ))
                 THEN 'context.occupancy.type' END) AS reasons
        FROM kinds
    )
"""


@query("read_check_requests", _TYPED + """
    SELECT element_id, CASE WHEN k_type = 'VARCHAR' THEN s_type END AS element_type, n_width AS width_mm,
           n_height AS height_mm, s_room AS room_type,
           CAST(CASE WHEN n_occ = floor(n_occ) THEN n_occ END AS INT) AS occupancy,
           coalesce(k_context = 'OBJECT', false) AS has_context
    FROM faults
""")
def read_check_requests(t: Inputs) -> DataFrame:
    return requests.read_check_requests(t.request_texts).select(
        "element_id", "element_type", "properties.width_mm", "properties.height_mm", "context.room_type",
        "context.occupancy", F.col("context").isNotNull().alias("has_context"),
    )


_VALIDATED = _TYPED + """
    SELECT element_id, reasons = '' AS valid, reasons, CASE WHEN reasons = '' THEN n_width END AS width_mm
    FROM faults
"""


def _split(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    good = valid.select("element_id", F.lit(True).alias("valid"), F.lit("").alias("reasons"), "properties.width_mm")
    bad = rejected.select(
        "element_id", F.lit(False).alias("valid"), F.array_join("reasons", ",").alias("reasons"),
        F.lit(None).cast("double").alias("width_mm"),
    )
    return good.unionByName(bad)


@query("validate_requests", _VALIDATED)
def validate_requests(t: Inputs) -> DataFrame:
    """Both parts in one pass, as a job that stores them together reads them."""
    valid = F.size("reasons") == 0
    return requests.read_check_requests(t.request_texts).select(
        "element_id", valid.alias("valid"), F.array_join("reasons", ",").alias("reasons"),
        F.when(valid, F.col("properties.width_mm")).alias("width_mm"),
    )


@query("error_policy", _VALIDATED)
def error_policy(t: Inputs) -> DataFrame:
    """Both parts, as one pass has stored them."""
    path = scratch_path(t.spark, "requests")
    policy.store_requests(t.request_texts, 0, path, "isolate")
    return _split(*policy.stored_requests(t.spark, path))


@query("error_policy_fail", _VALIDATED + """
    WHERE split_part(element_id, '-', 2) NOT IN (SELECT split_part(element_id, '-', 2) FROM faults WHERE reasons <> '')
""")
def error_policy_fail(t: Inputs) -> DataFrame:
    """Requests in batches by their line number: a batch with a bad one is not published."""
    path = scratch_path(t.spark, "requests")
    for line in range(1, 8):
        # the batch is picked where the table is read, before any text is made
        texts = t.spark.sql(VIEWS["request_texts"], lineitem=t.lineitem.filter(F.col("l_linenumber") == line))
        try:
            policy.store_requests(texts, line, path, "fail")
        except policy.RejectedRequests:
            continue
    return _split(*policy.stored_requests(t.spark, path))


@query("write_check_responses", """
    SELECT element_id, concat(chr(123), '"compliant":', CASE WHEN broken THEN 'false' ELSE 'true' END, ',"violations":[',
        CASE WHEN broken THEN concat(chr(123), '"rule_id":"ČSN_73_0802_Sec_5.2.a","severity":"critical","message":"',
            'Corridor width (', width_mm, 'mm) is less than minimum ', min_width, 'mm required by ČSN 73 0802',
            '","required_value":', CAST(min_width AS DOUBLE), ',"actual_value":', width_mm,
            ',"code_reference":"Section 5.2(a) - Escape Routes","confidence_score":0.98', chr(125)) ELSE '' END,
        '],"recommendations":[',
        CASE WHEN broken THEN concat('"Increase ', lower(element_type), ' spacing to meet minimum requirements"') ELSE '' END,
        '],"checked_at":"', strftime(stamp, '%Y-%m-%dT%H:%M:%SZ'), '"', chr(125)) AS json
    FROM {project_judged}
""")
def write_check_responses(t: Inputs) -> DataFrame:
    return requests.to_response_json(t.checked()).select("element_id", "json")


@query("relevant_elements", """
    SELECT element_id, category FROM {raw_elements} WHERE category IN ('Wall', 'Door', 'Window', 'Floor', 'Room', 'Stairs')
""")
def relevant_elements(t: Inputs) -> DataFrame:
    return extract.relevant(t.raw_elements).select("element_id", "category")


@query("triggered_changes", """
    SELECT id, element_id, category FROM {changes} WHERE change_type = 'modified' AND category IN ('Wall', 'Door')
""")
def triggered_changes(t: Inputs) -> DataFrame:
    return extract.triggered(t.changes).select("id", "element_id", "category")


@query("extract_properties", """
    SELECT element_id, coalesce(category, 'Unknown') AS element_type,
           CASE kind WHEN 'wall' THEN wall_width WHEN 'family' THEN coalesce(width_en, width_cs) END
               * CAST(304.8 AS DOUBLE) AS width_mm,
           CASE kind WHEN 'wall' THEN wall_height WHEN 'family' THEN coalesce(height_en, height_cs) END
               * CAST(304.8 AS DOUBLE) AS height_mm,
           CASE kind WHEN 'wall' THEN wall_function WHEN 'family' THEN family_name END AS function
    FROM {raw_elements}
""")
def extract_properties(t: Inputs) -> DataFrame:
    return extract.extract_properties(t.with_params(t.raw_elements)).select(
        "element_id", "element_type", "properties.width_mm", "properties.height_mm", "properties.function"
    )


@query("bilingual_param", """
    SELECT element_id, coalesce(width_en, width_cs) AS width, coalesce(height_en, height_cs) AS height FROM {raw_elements}
""")
def bilingual_param(t: Inputs) -> DataFrame:
    params = F.col("params")
    return t.with_params(t.raw_elements).select(
        "element_id", first_param(params, *extract.WIDTH_NAMES).alias("width"),
        first_param(params, *extract.HEIGHT_NAMES).alias("height"),
    )


@query("element_type", """
    SELECT element_id, coalesce(category, 'Unknown') AS element_type, lower(coalesce(category, 'Unknown')) AS folded_type
    FROM {raw_elements}
""")
def element_types(t: Inputs) -> DataFrame:
    category = F.col("category")
    return t.raw_elements.select(
        "element_id", element_type(category).alias("element_type"),
        element_type(category, normalise=True).alias("folded_type"),
    )


@query("default_building_type", """
    SELECT element_id, coalesce(p.building_type, 'Residential') AS building_type
    FROM {project_elements} e LEFT JOIN {projects} p ON p.id = e.project_id
""")
def default_building_type(t: Inputs) -> DataFrame:
    return t.placed().select("element_id", "building_type")


_FLOOR = """CASE WHEN NOT has_level_param THEN NULL WHEN name IS NULL THEN 0
    WHEN regexp_full_match(name, '\\s*[+-]?[0-9]+\\s*') AND TRY_CAST(trim(name) AS INT) IS NOT NULL THEN TRY_CAST(trim(name) AS INT)
    WHEN contains(name, '1') OR contains(lower(name), 'first') OR contains(lower(name), 'ground') THEN 1
    WHEN contains(name, '2') OR contains(lower(name), 'second') THEN 2 ELSE 0 END"""


@query("floor_number", f"""
    SELECT element_id, {_FLOOR} AS floor_level
    FROM (SELECT element_id, has_level_param,
                 CASE level_id % 5 WHEN 0 THEN concat('Level ', level_id) WHEN 1 THEN concat(' ', level_id, ' ')
                                   WHEN 2 THEN category WHEN 3 THEN concat('-', level_id) ELSE 'Second floor' END AS name
          FROM {{raw_elements}}) e
""")
def floor_numbers(t: Inputs) -> DataFrame:
    level = F.col("level_id")
    case = F.pmod(level, F.lit(5))
    name = (
        F.when(case == 0, F.concat(F.lit("Level "), level)).when(case == 1, F.concat(F.lit(" "), level, F.lit(" ")))
        .when(case == 2, F.col("category")).when(case == 3, F.concat(F.lit("-"), level)).otherwise("Second floor")
    )
    return t.raw_elements.select("element_id", floor_number(name, F.col("has_level_param")).alias("floor_level"))


@query("unit_convert", """
    SELECT element_id, width_ft * CAST(304.8 AS DOUBLE) AS width_mm, width_ft / CAST(304.8 AS DOUBLE) AS width_feet,
           width_ft * height_ft * CAST(0.092903 AS DOUBLE) AS area_sqm
    FROM {elements}
""")
def unit_convert(t: Inputs) -> DataFrame:
    width, height = F.col("width_ft"), F.col("height_ft")
    return t.elements.select(
        "element_id", feet_to_mm(width).alias("width_mm"), mm_to_feet(width).alias("width_feet"),
        sqft_to_sqm(width * height).alias("area_sqm"),
    )


@query("rule_applies", "SELECT element_id, applies FROM {judged}")
def rule_applies(t: Inputs) -> DataFrame:
    applies = corridor.rule_applies(F.col("element_type"), F.col("context.room_type"))
    return t.records(t.elements).select("element_id", applies.alias("applies"))


@query("required_width", "SELECT element_id, min_width FROM {judged}")
def required_width(t: Inputs) -> DataFrame:
    return t.records(t.elements).select(
        "element_id", corridor.required_width(F.col("context.occupancy")).alias("min_width")
    )


_FLAGSHIP = """
    SELECT element_id, NOT broken AS compliant,
           CASE WHEN broken THEN 'ČSN_73_0802_Sec_5.2.a' END AS rule_id,
           CASE WHEN broken THEN 'critical' END AS severity,
           CASE WHEN broken THEN concat('Corridor width (', width_mm, 'mm) is less than minimum ', min_width,
                                        'mm required by ČSN 73 0802') END AS message,
           CASE WHEN broken THEN CAST(min_width AS DOUBLE) END AS required_value,
           CASE WHEN broken THEN width_mm END AS actual_value,
           CASE WHEN broken THEN concat('Increase ', lower(element_type), ' spacing to meet minimum requirements')
                END AS recommendation,
           strftime(stamp, '%Y-%m-%dT%H:%M:%SZ') AS checked_at
    FROM {project_judged}
"""


@query("corridor_check", _FLAGSHIP)
def corridor_check(t: Inputs) -> DataFrame:
    first = F.get("violations", F.lit(0))
    return t.checked().select(
        "element_id", "compliant",
        *[first[c].alias(c) for c in ("rule_id", "severity", "message", "required_value", "actual_value")],
        F.get("recommendations", F.lit(0)).alias("recommendation"), "checked_at",
    )


_VIOLATION_COLUMNS = (
    "rule_id", "severity", "message", "required_value", "actual_value", "code_reference", "confidence_score"
)


@query("violation_record", f"SELECT element_id, {', '.join(_VIOLATION_COLUMNS)} FROM {{corridor_violations}}")
def violation_record(t: Inputs) -> DataFrame:
    return corridor.explode_violations(t.checked(), "element_id")


@query("check_outcome", """
    SELECT element_id, NOT broken AS compliant, CAST(broken AS INT) AS violations_count,
           CASE WHEN broken THEN concat('Increase ', lower(element_type), ' spacing to meet minimum requirements')
                ELSE '' END AS recommendations
    FROM {project_judged}
""")
def check_outcome(t: Inputs) -> DataFrame:
    return t.checked().select(
        "element_id", "compliant", F.size("violations").alias("violations_count"),
        F.array_join("recommendations", "|").alias("recommendations"),
    )


@query("checked_at", """
    SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'),
           CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END, 'Z') AS checked_at FROM {events}
""")
def checked_at(t: Inputs) -> DataFrame:
    return t.events.select("event_id", iso_stamp(F.col("ts")).alias("checked_at"))


@query("violation_alerts", "SELECT element_id, severity, message FROM {corridor_violations}")
def violation_alerts(t: Inputs) -> DataFrame:
    return corridor.violation_alerts(t.checked()).select("element_id", "severity", "message")


@query("domain_check", """
    SELECT rule_id, severity, confidence_score,
           coalesce(severity IN ('critical', 'warning', 'info') AND confidence_score BETWEEN 0 AND 1, false) AS accepted
    FROM (SELECT rule_id, CASE WHEN value_mm = 40 THEN 'fatal' WHEN value_mm = 80 THEN NULL ELSE severity END AS severity,
                 value_mm / CAST(1900.0 AS DOUBLE) AS confidence_score FROM {part_rules}) r
""")
def domain_check(t: Inputs) -> DataFrame:
    value = F.col("value_mm")
    severity = F.when(value == 40, "fatal").when(value != 80, F.col("severity"))
    rows = t.part_rules.select("rule_id", severity.alias("severity"), (value / 1900.0).alias("confidence_score"))
    good, bad = integrity.domain_check(rows)
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@query("batch_summary", """
    SELECT count(*) AS checked, CAST(count(*) FILTER (broken) AS BIGINT) AS violations,
           concat('Checked ', count(*), ' element(s).', chr(10), 'Found ', count(*) FILTER (broken),
                  ' violation(s). See log for details.') AS message
    FROM {judged_elements}
""")
def batch_summary(t: Inputs) -> DataFrame:
    return reports.batch_summary(corridor.check_corridor(t.records(t.elements)))


@query("check_model", """
    SELECT count(*) AS checked, CAST(count(*) FILTER (broken) AS BIGINT) AS violations,
           concat('Checked ', count(*), ' element(s).', chr(10), 'Found ', count(*) FILTER (broken), ' violation(s). See log for details.') AS message
    FROM (
        SELECT lower(e.category) IN ('wall', 'corridor') AND coalesce(h.room_type = 'Corridor', false) AND width_mm < 1200 AS broken
        FROM (SELECT *, CASE kind WHEN 'wall' THEN wall_width WHEN 'family' THEN coalesce(width_en, width_cs) END
                        * CAST(304.8 AS DOUBLE) AS width_mm FROM {raw_elements}) e LEFT JOIN (
            SELECT p.level_id, p.x, p.y, min_by(r.name, r.room_id) AS room_type
            FROM (SELECT DISTINCT level_id, x, y FROM {raw_elements} WHERE location_kind = 'point') p
            JOIN {rooms} r ON r.level_id = p.level_id AND p.x >= r.x0 AND p.x < r.x1 AND p.y >= r.y0 AND p.y < r.y1
            GROUP BY p.level_id, p.x, p.y) h
        ON e.location_kind = 'point' AND h.level_id = e.level_id AND h.x = e.x AND h.y = e.y
        WHERE width_mm IS NOT NULL) c
""")
def check_model(t: Inputs) -> DataFrame:
    """From raw model rows to the summary: properties, level, room, check; rows without a width are refused."""
    found = extract.extract_properties(t.with_params(t.raw_elements)).filter(F.col("properties.width_mm").isNotNull())
    placed = enrich.join_rooms(enrich.join_levels(found, t.levels), t.rooms)
    records = extract.with_context(placed, F.col("room_type"), F.col("floor_level"))
    return reports.batch_summary(corridor.check_corridor(records))


@query("join_levels", f"""
    SELECT element_id, name AS level_name, {_FLOOR} AS floor_level
    FROM {{raw_elements}} e LEFT JOIN {{levels}} l ON l.level_id = e.level_id
""")
def join_levels(t: Inputs) -> DataFrame:
    return enrich.join_levels(t.raw_elements, t.levels).select("element_id", "level_name", "floor_level")


@query("join_rooms", """
    SELECT e.element_id, h.room_id, h.room_type
    FROM {raw_elements} e LEFT JOIN (
        SELECT p.level_id, p.x, p.y, min(r.room_id) AS room_id, first(r.name ORDER BY r.room_id, r.name NULLS FIRST) AS room_type
        FROM (SELECT DISTINCT level_id, x, y FROM {raw_elements} WHERE location_kind = 'point') p
        JOIN {rooms} r ON r.level_id = p.level_id AND p.x >= r.x0 AND p.x < r.x1 AND p.y >= r.y0 AND p.y < r.y1
        GROUP BY p.level_id, p.x, p.y) h
    ON e.location_kind = 'point' AND h.level_id = e.level_id AND h.x = e.x AND h.y = e.y
""")
def join_rooms(t: Inputs) -> DataFrame:
    return enrich.join_rooms(t.raw_elements, t.rooms).select("element_id", "room_id", "room_type")


@query("join_projects", """
    SELECT element_id, project_id, p.name AS project_name, coalesce(p.building_type, 'Residential') AS building_type
    FROM {project_elements} e LEFT JOIN {projects} p ON p.id = e.project_id
""")
def join_projects(t: Inputs) -> DataFrame:
    return t.placed().select("element_id", "project_id", "project_name", "building_type")


# ---------------------------------------------------------------- table rules

@query("list_rules", """
    SELECT count(*) OVER () AS total_rules, rule_id, title, rule_type, severity, CAST(NULL AS VARCHAR) AS message
    FROM {part_rules} WHERE is_active
""")
def list_rules(t: Inputs) -> DataFrame:
    return rules.list_rules(t.part_rules)


@query("total_rules", "SELECT count(*) AS total_rules FROM {part_rules} WHERE is_active")
def total_rules(t: Inputs) -> DataFrame:
    return rules.total_rules(t.part_rules)


@query("active_rules", """
    SELECT rule_id, rule_type, geometry_type, version FROM {part_rules} WHERE is_active AND language = 'cs'
""")
def active_rules(t: Inputs) -> DataFrame:
    return rules.active_rules(t.part_rules).select("rule_id", "rule_type", "geometry_type", "version")


@query("evaluate_rules", f"SELECT element_id, {', '.join(_VIOLATION_COLUMNS)} FROM {{table_violations}}")
def evaluate_rules(t: Inputs) -> DataFrame:
    return rules.evaluate_rules(t.placed(), rules.active_rules(t.rules, language=None))


@query("evaluate_part_rules", f"SELECT element_id, {', '.join(_VIOLATION_COLUMNS)} FROM {{part_violations}}")
def evaluate_part_rules(t: Inputs) -> DataFrame:
    """The same operator on a catalogue that grows with the elements: ten times the violations."""
    return rules.evaluate_rules(t.placed(), rules.active_rules(t.part_rules, language=None))


@query("unevaluated_rules", """
    SELECT e.element_id, count(m.rule_id) AS unevaluated
    FROM {project_elements} e LEFT JOIN (SELECT * FROM {matched} WHERE rule_type = 'fire_rating') m
         ON m.element_id = e.element_id
    GROUP BY e.element_id
""")
def unevaluated_rules(t: Inputs) -> DataFrame:
    return rules.unevaluated_rules(t.placed(), rules.active_rules(t.rules, language=None))


@query("elements_without_rules", """
    SELECT element_id, element_type, building_type, element_id IN (SELECT element_id FROM {matched}) AS covered FROM {placed}
""")
def elements_without_rules(t: Inputs) -> DataFrame:
    elements = t.placed().select("element_id", "element_type", "building_type")
    active = rules.active_rules(t.rules, language=None)
    missing = rules.elements_without_rules(elements, active).withColumn("covered", F.lit(False))
    return missing.unionByName(rules.elements_with_rules(elements, active).withColumn("covered", F.lit(True)))


@query("all_violations", f"""
    SELECT element_id, {', '.join(_VIOLATION_COLUMNS)} FROM {{corridor_violations}}
    UNION ALL SELECT element_id, {', '.join(_VIOLATION_COLUMNS)} FROM {{table_violations}}
""")
def all_violations(t: Inputs) -> DataFrame:
    # the built-in rule asks nothing of the project, so its elements are judged before they meet an order
    return rules.all_violations(t.placed(), t.records(t.project_elements), rules.active_rules(t.rules, language=None))


@query("rule_candidates", r"""
    WITH RECURSIVE sentences AS (
        SELECT chunk_id, unnest(regexp_split_to_array(text, '[!?;\n]+|\.\s+|\.$')) AS sentence FROM {rule_texts}
    ), cues AS (
        SELECT *, CASE WHEN regexp_matches(sentence, '(?i)(minimum|minimal|minimáln|at least|nejméně|not less than)') THEN 'min'
                       WHEN regexp_matches(sentence, '(?i)(maximum|maximal|maximáln|at most|nejvýše|not more than)') THEN 'max'
                  END AS cue FROM sentences
    )
    SELECT chunk_id, cue, nullif(regexp_extract(sentence, '(?i)(?:section|čl\.|oddíl|§)\s*([0-9]+(?:\.[0-9]+)*(?:\([a-z]\))?)', 1), '')
               AS code_reference, CAST(replace(v, ',', '.') AS DOUBLE) AS value_mm
    FROM (SELECT *, unnest(regexp_extract_all(sentence, '([0-9]+(?:[.,][0-9]+)?)\s*mm\b', 1)) AS v FROM cues WHERE cue IS NOT NULL) c
""")
def rule_candidates(t: Inputs) -> DataFrame:
    return rules.rule_candidates(t.rule_texts)
