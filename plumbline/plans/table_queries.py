"""Queries over the relational tables: storage, integrity, reports and history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import cache, enrich, history, integrity, persist, reports, rules
from plumbline.operators.corridor import CORRIDOR_RULE
from plumbline.plans.registry import Inputs, query
from plumbline.session import cut_lineage, scratch_path
from plumbline.sources import tables


def _rules_with_builtin(t: Inputs) -> DataFrame:
    """The rule table with a row for the built-in rule, so that its violations have a key."""
    head = t.spark.range(-1, 0).select(
        "id", F.lit(CORRIDOR_RULE["rule_id"]).alias("rule_id"), F.lit("corridor_width").alias("rule_type"),
        F.lit("corridor").alias("geometry_type"), F.lit("Corridor width").alias("title"),
        F.lit("Corridor width").alias("description"),
        F.lit(CORRIDOR_RULE["code_reference"]).alias("code_reference"),
        F.lit(CORRIDOR_RULE["severity"]).alias("severity"), F.lit(True).alias("is_active"),
    )
    return t.rules.unionByName(head, allowMissingColumns=True)


def _five(t: Inputs) -> dict[str, DataFrame]:
    checks = persist.check_rows(t.checked())
    results = persist.result_rows(checks, _rules_with_builtin(t)).filter("rule_id IS NOT NULL").drop("rule_text")
    return {
        "users": t.users, "projects": t.projects, "compliance_rules": _rules_with_builtin(t),
        "compliance_checks": checks.drop("violations"),
        "check_results": results.withColumn("id", F.col("check_id")),
    }


@query("load_tables", """
    SELECT 'users' AS table_name, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM {users}
    UNION ALL SELECT 'projects', count(*), CAST(sum(id) AS BIGINT) FROM {projects}
    UNION ALL SELECT 'compliance_rules', count(*), CAST(sum(id) AS BIGINT) FROM {part_rules}
    UNION ALL SELECT 'compliance_checks', count(*), CAST(sum(project_id) AS BIGINT) FROM {project_elements}
    UNION ALL SELECT 'check_results', count(*), CAST(sum(required_value) AS BIGINT) FROM {corridor_violations}
""")
def load_tables(t: Inputs) -> DataFrame:
    path, parts = scratch_path(t.spark, "tables"), []
    checks = persist.check_rows(cut_lineage(t.checked().withColumn("id", F.monotonically_increasing_id())))
    results = persist.result_rows(checks, _rules_with_builtin(t)).drop("rule_text").withColumn("id", F.monotonically_increasing_id())
    stored_tables = (
        ("users", t.users, "id"), ("projects", t.projects, "id"), ("compliance_rules", t.part_rules, "id"),
        ("compliance_checks", checks.drop("violations"), "project_id"), ("check_results", results, "required_value"),
    )
    for name, df, summed in stored_tables:
        tables.write_table(integrity.apply_defaults(_all_columns(df, name), name), name, f"{path}/{name}")
        stored = tables.load_table(t.spark, name, f"{path}/{name}")
        parts.append(stored.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.sum(summed).cast("long").alias("ids")
        ))
    return reduce(DataFrame.unionByName, parts)


def _all_columns(df: DataFrame, name: str) -> DataFrame:
    missing = [f for f in schemas.table_schema(name).fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


@query("json_columns", """
    SELECT id, CASE WHEN building_types IS NULL THEN NULL
                    ELSE concat('["', array_to_string(building_types, '","'), '"]') END AS building_types_json,
           building_types[1] AS first_type, len(building_types) AS types
    FROM {part_rules}
""")
def json_columns(t: Inputs) -> DataFrame:
    encoded = tables.encode_json(t.part_rules, "compliance_rules").withColumn("building_types_json", F.col("building_types"))
    decoded = tables.decode_json(encoded.select("id", "building_types", "building_types_json"), "compliance_rules")
    types = F.col("building_types")
    return decoded.select(
        "id", "building_types_json", F.get(types, F.lit(0)).alias("first_type"),
        F.when(types.isNotNull(), F.size(types)).cast("long").alias("types"),
    )


@query("persist_checks", """
    SELECT e.element_id, e.project_id, NOT e.broken AS is_compliant, CASE WHEN v.id IS NOT NULL THEN -1 END AS rule_key, v.severity,
           v.message, v.required_value, v.actual_value, v.confidence_score, strftime(e.stamp, '%Y-%m-%d') AS check_date
    FROM {project_judged} e LEFT JOIN {corridor_violations} v ON v.id = e.id
""")
def persist_checks(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "persist")
    persist.persist(t.checked().drop("id"), _rules_with_builtin(t), path, grain="year")
    checks = persist.read_stored(t.spark, path, "compliance_checks")
    results = persist.read_stored(t.spark, path, "check_results").drop("id", "batch_id")
    own = checks.select(F.col("id").alias("check_id"), "element_id", "project_id", "is_compliant", "checked_at")
    return own.join(results, "check_id", "left").select(
        "element_id", "project_id", "is_compliant", F.col("rule_id").cast("int").alias("rule_key"), "severity", "message",
        "required_value", "actual_value", "confidence_score", F.date_format("checked_at", "yyyy-MM-dd").alias("check_date"),
    )


@query("apply_defaults", """
    SELECT rule_id, CASE WHEN severity = 'info' THEN 'warning' ELSE severity END AS severity,
           CASE WHEN language = 'en' THEN 'cs' ELSE language END AS language,
           true AS is_active, '2024-05-01T00:00:00Z' AS created_at FROM {part_rules}
""")
def apply_defaults(t: Inputs) -> DataFrame:
    from plumbline.functions.text import iso_stamp

    partial = t.part_rules.withColumns({
        "severity": F.nullif("severity", F.lit("info")), "language": F.nullif("language", F.lit("en")),
        "is_active": F.nullif("is_active", F.lit(False)),
    })
    filled = integrity.apply_defaults(partial, "compliance_rules", F.lit("2024-05-01 00:00:00").cast("timestamp_ntz"))
    return filled.select("rule_id", "severity", "language", "is_active", iso_stamp(F.col("created_at")).alias("created_at"))


@query("tenant_scope", """
    SELECT element_id, project_id FROM {project_elements}
    WHERE project_id IN (SELECT id FROM {projects} WHERE user_id = 7)
""")
def tenant_scope(t: Inputs) -> DataFrame:
    return enrich.for_user(t.project_elements, t.projects, 7).select("element_id", "project_id")


# ---------------------------------------------------------------- integrity

_NULLS = """
    SELECT 'users' AS table_name, unnest(['id', 'email', 'hashed_password']) AS column_name,
           unnest([count(*) - count(id), count(*) - count(email), count(*) - count(hashed_password)]) AS nulls FROM {users}
    UNION ALL SELECT 'projects', unnest(['id', 'user_id', 'name']),
           unnest([count(*) - count(id), count(*) - count(user_id), count(*) - count(name)]) FROM {projects}
    UNION ALL SELECT 'compliance_rules',
           unnest(['id', 'rule_id', 'rule_type', 'geometry_type', 'title', 'description', 'code_reference']),
           unnest([count(*) - count(id), count(*) - count(rule_id), count(*) - count(rule_type),
                   count(*) - count(geometry_type), count(*) - count(title), count(*) - count(description),
                   count(*) - count(code_reference)]) FROM {rules}
    UNION ALL SELECT 'compliance_checks',
           unnest(['id', 'project_id', 'element_id', 'element_type', 'properties', 'is_compliant']),
           unnest([count(*) - count(id), count(*) - count(project_id), count(*) - count(element_id),
                   count(*) - count(element_type), count(*) - count(width_mm), count(*) - count(broken)]) FROM {project_judged}
    UNION ALL SELECT 'check_results',
           unnest(['id', 'check_id', 'rule_id', 'severity', 'message', 'confidence_score']),
           unnest([count(*) - count(id), count(*) - count(id), count(*) - count(rule_id), count(*) - count(severity),
                   count(*) - count(message), count(*) - count(confidence_score)]) FROM {corridor_violations}
"""


@query("not_null_report", _NULLS)
def not_null_report(t: Inputs) -> DataFrame:
    return integrity.not_null_report(_five(t))


_COPIES = """
    SELECT 'users' AS table_name, 'email' AS column_name, email AS key, count(*) AS copies FROM {users}
    WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
    UNION ALL SELECT 'projects', 'id', CAST(id AS VARCHAR), count(*) FROM {projects} GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'compliance_rules', 'rule_id', rule_id, count(*) FROM {rules} GROUP BY rule_id HAVING count(*) > 1
    UNION ALL SELECT 'compliance_checks', 'id', CAST(id AS VARCHAR), count(*) FROM {project_elements} GROUP BY id HAVING count(*) > 1
"""


@query("unique_report", _COPIES)
def unique_report(t: Inputs) -> DataFrame:
    return integrity.unique_report(_five(t))


_ORPHANS = """
    SELECT 'projects' AS table_name, 'user_id' AS column_name, CAST(user_id AS VARCHAR) AS key, count(*) AS rows FROM {projects}
    WHERE user_id NOT IN (SELECT id FROM {users}) GROUP BY user_id
    UNION ALL SELECT 'compliance_checks', 'project_id', CAST(project_id AS VARCHAR), count(*) FROM {project_elements}
    WHERE project_id NOT IN (SELECT id FROM {projects}) GROUP BY project_id
"""


@query("orphan_report", _ORPHANS)
def orphan_report(t: Inputs) -> DataFrame:
    return integrity.orphan_report(_five(t))


@query("health_rollup", f"""
    WITH RECURSIVE n AS ({_NULLS}), u AS ({_COPIES}), o AS ({_ORPHANS}), s AS (
        SELECT CASE WHEN (SELECT sum(nulls) FROM n) = 0 THEN 'healthy' ELSE 'unhealthy' END AS not_null_status,
               CASE WHEN (SELECT count(*) FROM u) = 0 THEN 'healthy' ELSE 'unhealthy' END AS unique_status,
               CASE WHEN (SELECT count(*) FROM o) = 0 THEN 'healthy' ELSE 'unhealthy' END AS foreign_key_status)
    SELECT CASE WHEN not_null_status = 'healthy' AND unique_status = 'healthy' AND foreign_key_status = 'healthy'
                THEN 'healthy' ELSE 'degraded' END AS status, * FROM s
""")
def health_rollup(t: Inputs) -> DataFrame:
    return integrity.health_rollup(_five(t))


# ---------------------------------------------------------------- joins on stored keys

@query("resolve_rule_keys", """
    SELECT v.element_id, v.rule_id, r.id AS rule_key, r.code_reference AS rule_reference, r.id IS NOT NULL AS resolved
    FROM (SELECT element_id, rule_id FROM {table_violations} UNION ALL SELECT element_id, rule_id FROM {corridor_violations}) v
    LEFT JOIN {rules} r ON r.rule_id = v.rule_id
""")
def resolve_rule_keys(t: Inputs) -> DataFrame:
    found = rules.all_violations(t.placed(), t.records(t.project_elements), rules.active_rules(t.rules, language=None))
    return enrich.with_rule_keys(found.select("element_id", "rule_id"), t.rules).withColumn("resolved", F.col("rule_key").isNotNull())


@query("check_detail", """
    SELECT v.id AS check_id, v.element_id, p.name AS project_name, u.email, v.rule_id, v.code_reference, v.message
    FROM {corridor_violations} v JOIN {projects} p ON p.id = v.project_id JOIN {users} u ON u.id = p.user_id
""")
def check_detail(t: Inputs) -> DataFrame:
    f = _five(t)
    detail = enrich.check_detail(
        f["users"], f["projects"], f["compliance_checks"], f["check_results"], f["compliance_rules"]
    )
    return detail.select("check_id", "element_id", "project_name", "email", "rule_id", "code_reference", "message")


# ---------------------------------------------------------------- reports

@query("violations_per_check", """
    SELECT id AS check_id, CAST(count(*) AS INT) AS violations_count FROM {corridor_violations} GROUP BY id
""")
def violations_per_check(t: Inputs) -> DataFrame:
    return reports.violations_per_check(_five(t)["check_results"])


@query("project_analysis", """
    WITH RECURSIVE rows AS (
        SELECT coalesce(p.building_type, 'unknown') AS building_type, e.project_id, e.broken
        FROM {project_judged} e LEFT JOIN {projects} p ON p.id = e.project_id)
    SELECT building_type, project_id, CAST(grouping(building_type) * 2 + grouping(project_id) AS INT) AS level,
           count(*) AS checks, count(*) FILTER (broken) AS failed, count(*) FILTER (broken) AS critical,
           CAST(0 AS BIGINT) AS warning, CAST(0 AS BIGINT) AS info,
           round(1 - count(*) FILTER (broken) / CAST(count(*) AS DOUBLE), 6) AS compliance_rate
    FROM rows GROUP BY ROLLUP (building_type, project_id)
""")
def project_analysis(t: Inputs) -> DataFrame:
    f = _five(t)
    return reports.project_analysis(f["compliance_checks"], f["check_results"], f["projects"])


def _placed_violations(t: Inputs) -> DataFrame:
    active = rules.active_rules(t.rules, language=None)
    alike = reports.counted_elements(t.placed(), ("level_id",))
    found = rules.evaluate_rules(alike, active, keep=("level_id", "n"))
    return found.withColumnRenamed("level_id", "floor_level")


@query("compliance_report", """
    SELECT rule_id, level_id AS floor_level, count(*) FILTER (severity = 'critical') AS critical,
           count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS total
    FROM {table_violations} GROUP BY rule_id, level_id
""")
def compliance_report(t: Inputs) -> DataFrame:
    return reports.compliance_report(_placed_violations(t))


@query("top_rules", """
    SELECT rule_id, count(*) AS violations FROM {table_violations} GROUP BY rule_id ORDER BY violations DESC, rule_id LIMIT 10
""")
def top_rules(t: Inputs) -> DataFrame:
    return reports.top_rules(_placed_violations(t))


@query("latency_profile", """
    WITH RECURSIVE s AS (
        SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M') AS minute, CAST(round(latency / 0.01) AS BIGINT) AS step
        FROM {cache_requests}
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY minute ORDER BY step) AS i, count(*) OVER (PARTITION BY minute) AS n FROM s
    )
    SELECT minute, max(n) AS requests,
           round(min(step) FILTER (i >= ceil(n * CAST(0.95 AS DOUBLE))) * CAST(0.01 AS DOUBLE), 6) AS latency_quantile
    FROM r GROUP BY minute
""")
def latency_profile(t: Inputs) -> DataFrame:
    return reports.latency_profile(t.cache_requests).withColumn(
        "minute", F.date_format("minute", "yyyy-MM-dd'T'HH:mm")
    )


# latencies by steps of one percent each way; the middle of the step of each rank
LATENCY_HOURS = """
    WITH RECURSIVE s AS (
        SELECT date_trunc('hour', ts) AS h, CASE WHEN latency > 0 THEN CAST(ceil(ln(latency) / ln(CAST(1.01 AS DOUBLE) / 0.99)) AS BIGINT) END AS step
        FROM {cache_requests} WHERE latency IS NOT NULL
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY h ORDER BY step NULLS FIRST) AS i, count(*) OVER (PARTITION BY h) AS n FROM s
    ), v AS (
        SELECT *, coalesce(CAST(2 AS DOUBLE) / (CAST(1.01 AS DOUBLE) / 0.99 + 1) * pow(CAST(1.01 AS DOUBLE) / 0.99, step), 0) AS middle FROM r
    )
    SELECT strftime(h, '%Y-%m-%dT%H:%M') AS window_start, CAST(max(n) AS BIGINT) AS requests,
           round(min(middle) FILTER (i = ceil(n * CAST(0.5 AS DOUBLE))), 6) AS p50,
           round(min(middle) FILTER (i = ceil(n * CAST(0.95 AS DOUBLE))), 6) AS p95,
           round(min(middle) FILTER (i = ceil(n * CAST(0.99 AS DOUBLE))), 6) AS p99
    FROM v GROUP BY h
"""


@query("latency_hours", LATENCY_HOURS)
def latency_hours(t: Inputs) -> DataFrame:
    minutes = reports.latency_sketch(t.cache_requests, F.col("ts").cast("timestamp"))
    told = reports.sketch_quantiles(reports.merge_sketches(minutes), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return told.select(
        F.date_format("window_start", "yyyy-MM-dd'T'HH:mm").alias("window_start"), "requests",
        *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")],
    )


# ---------------------------------------------------------------- history and cache

@query("latest_result", """
    SELECT element_id, id, is_compliant, strftime(checked_at, '%Y-%m-%dT%H:%M:%S') AS checked_at FROM (
        SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY checked_at DESC, id DESC) AS i FROM {history}) h
    WHERE i = 1
""")
def latest_result(t: Inputs) -> DataFrame:
    return history.latest_result(t.history).withColumn("checked_at", F.date_format("checked_at", "yyyy-MM-dd'T'HH:mm:ss"))


TRANSITIONS = """
    SELECT element_id, id, is_compliant, transition,
           CAST(floor(epoch_us(checked_at - max(CASE WHEN transition <> 'same' THEN checked_at END)
               OVER (PARTITION BY element_id ORDER BY checked_at, id)) / 86400000000) AS INT) AS days_in_state
    FROM (SELECT *, CASE WHEN lag(is_compliant) OVER w IS NULL THEN 'first' WHEN lag(is_compliant) OVER w = is_compliant THEN 'same'
                         WHEN is_compliant THEN 'fixed' ELSE 'regressed' END AS transition
          FROM {history} WINDOW w AS (PARTITION BY element_id ORDER BY checked_at, id)) h
"""


@query("compliance_history", TRANSITIONS)
def compliance_history(t: Inputs) -> DataFrame:
    return history.compliance_history(t.history).drop("checked_at")


CACHE_HITS = """
    WITH RECURSIVE t AS (SELECT DISTINCT cache_key, epoch_us(ts) AS t FROM {cache_requests}), a AS (
        SELECT cache_key, min(t) AS t FROM t GROUP BY cache_key
        UNION ALL
        SELECT a.cache_key, min(t.t) FROM a JOIN t ON t.cache_key = a.cache_key AND t.t >= a.t + 3600000000
        GROUP BY a.cache_key, a.t
    ), h AS (
        SELECT r.request_id, r.cache_key, epoch_us(r.ts) AS t,
               a.t IS NULL OR row_number() OVER (PARTITION BY r.cache_key, r.ts ORDER BY r.request_id) > 1 AS hit
        FROM {cache_requests} r LEFT JOIN a ON a.cache_key = r.cache_key AND a.t = epoch_us(r.ts)
    )
"""


@query("result_cache", CACHE_HITS + "SELECT request_id, cache_key, hit FROM h")
def result_cache(t: Inputs) -> DataFrame:
    return cache.result_cache(t.cache_requests).select("request_id", "cache_key", "hit")


@query("cache_hit_rate", CACHE_HITS + """
    SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS hit_rate
    FROM h
""")
def cache_hit_rate(t: Inputs) -> DataFrame:
    return cache.cache_hit_rate(t.cache_requests)
