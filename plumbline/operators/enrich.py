"""Joins that add level, room and project data to elements.

No side is broadcast by hint: the optimizer broadcasts a lookup only while its known or
measured size is below ``spark.sql.autoBroadcastJoinThreshold``; a larger one becomes a
shuffle join whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import floor_number
from plumbline.operators.extract import DEFAULT_BUILDING_TYPE


def join_levels(elements: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds ``level_name`` and ``floor_level`` (left outer on ``level_id``)."""
    names = levels.select("level_id", F.col("name").alias("level_name"))
    return elements.join(names, "level_id", "left").withColumn(
        "floor_level", floor_number(F.col("level_name"), F.col("has_level_param"))
    )


def join_projects(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds ``project_name`` and ``building_type`` (project's own, else the default)."""
    own = projects.select(
        F.col("id").alias("project_id"), F.col("name").alias("project_name"),
        F.col("building_type").alias("_own_type"),
    )
    return df.join(own, "project_id", "left").withColumn(
        "building_type", F.coalesce("_own_type", F.lit(DEFAULT_BUILDING_TYPE))
    ).drop("_own_type")


def cell_size(rooms: DataFrame) -> Column:
    """Side of a grid cell, a subquery over the rooms: their median side, but never so small that
    the longest room touches more than about 64 cells along a side."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    solid = rooms.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    size = solid.agg(F.greatest(F.percentile_approx(side, 0.5), F.max(side) / 64).alias("size")).scalar()
    return F.coalesce(size, F.lit(1.0))


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("long")


def room_cells(rooms: DataFrame, size: Column) -> DataFrame:
    """Rooms repeated once per grid cell ``_cx, _cy`` their half-open box touches."""
    def span(low: str, high: str) -> Column:
        return F.sequence(F.col(low), F.greatest(F.col(low), F.col(high) - 1))

    solid = rooms.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    # the size is worked out once per room, before the explosion
    edges = solid.withColumns({
        "_a": _cell(F.col("x0"), size), "_b": F.ceil(F.col("x1") / size).cast("long"),
        "_c": _cell(F.col("y0"), size), "_d": F.ceil(F.col("y1") / size).cast("long"),
    })
    return edges.withColumn("_cx", F.explode(span("_a", "_b"))).withColumn("_cy", F.explode(span("_c", "_d"))).drop("_a", "_b", "_c", "_d")


def join_rooms(elements: DataFrame, rooms: DataFrame) -> DataFrame:
    """Adds ``room_id`` and ``room_type`` of the room at the element's point.

    Only point-located elements look for a room; among overlapping rooms the smallest id
    wins.  Distinct points meet rooms by grid cell, the winner of each point is a minimum
    that is combined before the shuffle, and elements look their point up: the same plan
    however many rooms a cell holds, and no element is grouped.
    """
    size = cell_size(rooms)
    is_point = F.col("location_kind") == "point"
    place = ["level_id", "x", "y"]
    points = elements.filter(is_point).dropna(subset=place).select(*place).distinct().withColumns({
        "_cx": _cell(F.col("x"), size), "_cy": _cell(F.col("y"), size),
    })
    boxes = room_cells(rooms, size).select(
        "level_id", "_cx", "_cy", "x0", "x1", "y0", "y1", F.struct("room_id", F.col("name").alias("room_type")).alias("_room"))
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))
    hits = points.join(boxes, ["level_id", "_cx", "_cy"]).filter(inside).groupBy(*place).agg(F.min("_room").alias("_hit"))
    found = hits.select(*[F.col(c).alias(f"_{c}") for c in place], "_hit")
    same = is_point & (F.col("level_id") == F.col("_level_id")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    rest = [c for c in elements.columns if c not in ("room_id", "room_type")]
    return elements.select(*rest).join(found, same, "left").select(
        *rest, F.col("_hit.room_id").alias("room_id"), F.col("_hit.room_type").alias("room_type"))


def with_rule_keys(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the integer ``rule_key`` and ``rule_reference`` of text rule ids; both are null for a rule that is not stored."""
    keys = rules.select(
        F.col("id").alias("rule_key"), "rule_id", F.col("code_reference").alias("rule_reference")
    )
    return violations.join(keys, "rule_id", "left")


def check_detail(users: DataFrame, projects: DataFrame, checks: DataFrame, results: DataFrame,
                 rules: DataFrame) -> DataFrame:
    """Results with their check, project, user and rule, following the declared keys."""
    results = results.select(
        F.col("id").alias("result_id"), "check_id", F.col("rule_id").alias("rule_key"),
        "severity", "message", "required_value", "actual_value", "confidence_score",
    )
    checks = checks.select(F.col("id").alias("check_id"), "project_id", "element_id", "element_type")
    projects = projects.select(
        F.col("id").alias("project_id"), "user_id", F.col("name").alias("project_name"), "building_type"
    )
    users = users.select(F.col("id").alias("user_id"), "email")
    rules = rules.select(F.col("id").alias("rule_key"), "rule_id", "code_reference")
    return (
        results.join(rules, "rule_key").join(checks, "check_id")
        .join(projects, "project_id").join(users, "user_id")
    )


def for_user(df: DataFrame, projects: DataFrame, user_id: int) -> DataFrame:
    """Rows whose project belongs to the user."""
    own = projects.filter(F.col("user_id") == user_id).select(F.col("id").alias("project_id"))
    return df.join(own, "project_id", "left_semi")
