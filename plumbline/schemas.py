"""Record and table schemas, with the constraints Spark does not enforce itself."""

from __future__ import annotations

from pyspark.sql import types as T

PROPERTIES = "width_mm DOUBLE, height_mm DOUBLE, length_mm DOUBLE, function STRING"
CONTEXT = "room_type STRING, building_type STRING, occupancy INT, floor_level INT"
VIOLATION = (
    "rule_id STRING, severity STRING, message STRING, required_value DOUBLE, "
    "actual_value DOUBLE, code_reference STRING, confidence_score DOUBLE"
)
REQUEST = f"element_type STRING, properties STRUCT<{PROPERTIES}>, context STRUCT<{CONTEXT}>"
RESPONSE = (
    f"compliant BOOLEAN, violations ARRAY<STRUCT<{VIOLATION}>>, "
    "recommendations ARRAY<STRING>, checked_at STRING"
)

# Table columns, in declared order.
TABLES = {
    "users": (
        "id BIGINT, email STRING, hashed_password STRING, full_name STRING, is_active BOOLEAN, "
        "is_superuser BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "projects": (
        "id BIGINT, user_id BIGINT, name STRING, description STRING, revit_version STRING, "
        "building_type STRING, location STRING, total_area_sqm INT, floor_count INT, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "compliance_rules": (
        "id BIGINT, rule_id STRING, rule_type STRING, geometry_type STRING, "
        "building_types ARRAY<STRING>, title STRING, description STRING, code_reference STRING, "
        "value_mm DOUBLE, value_text STRING, severity STRING, source_document STRING, "
        "page_number INT, language STRING, version STRING, is_active BOOLEAN, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "compliance_checks": (
        "id BIGINT, project_id BIGINT, element_id STRING, element_type STRING, "
        f"properties STRUCT<{PROPERTIES}>, context STRUCT<{CONTEXT}>, is_compliant BOOLEAN, "
        "violations_count INT, checked_at TIMESTAMP_NTZ"
    ),
    "check_results": (
        "id BIGINT, check_id BIGINT, rule_id BIGINT, severity STRING, message STRING, "
        "required_value DOUBLE, actual_value DOUBLE, confidence_score DOUBLE, "
        "created_at TIMESTAMP_NTZ"
    ),
}

NOT_NULL = {
    "users": ["id", "email", "hashed_password"],
    "projects": ["id", "user_id", "name"],
    "compliance_rules": [
        "id", "rule_id", "rule_type", "geometry_type", "title", "description", "code_reference",
    ],
    "compliance_checks": [
        "id", "project_id", "element_id", "element_type", "properties", "is_compliant",
    ],
    "check_results": ["id", "check_id", "rule_id", "severity", "message", "confidence_score"],
}

UNIQUE = {
    "users": ["id", "email"],
    "projects": ["id"],
    "compliance_rules": ["id", "rule_id"],
    "compliance_checks": ["id"],
    "check_results": ["id"],
}

# (child table, child column, parent table); parents are keyed by id.
FOREIGN_KEYS = [
    ("projects", "user_id", "users"),
    ("compliance_checks", "project_id", "projects"),
    ("check_results", "check_id", "compliance_checks"),
    ("check_results", "rule_id", "compliance_rules"),
]

# Declared defaults; "now" stands for the time stamp of the job.
DEFAULTS = {
    "users": {"is_active": True, "is_superuser": False, "created_at": "now", "updated_at": "now"},
    "projects": {"created_at": "now", "updated_at": "now"},
    "compliance_rules": {
        "severity": "warning", "language": "cs", "is_active": True,
        "created_at": "now", "updated_at": "now",
    },
    "compliance_checks": {"violations_count": 0, "checked_at": "now"},
    "check_results": {"created_at": "now"},
}

SEVERITIES = ["critical", "warning", "info"]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def table_schema(name: str) -> T.StructType:
    return struct(TABLES[name])
