"""Latest result and transitions per element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_result(checks: DataFrame) -> DataFrame:
    """The last check per element.

    ``max_by`` combines map-side: a hot element is one partial row per task, where a
    ``row_number`` window would sort all of it in one task.
    """
    rest = F.struct(*[c for c in checks.columns if c != "element_id"])
    last = checks.groupBy("element_id").agg(F.max_by(rest, F.struct("checked_at", "id")).alias("r"))
    return last.select("element_id", "r.*").select(*checks.columns)


def compliance_history(checks: DataFrame, time_slice: str = "day") -> DataFrame:
    """Each check with ``transition`` (first, same, fixed, regressed) and ``days_in_state``,
    the days since the state it is in began.

    Checks of one element are split by time slice, so the sorted unit is one slice of one
    element.  What a slice must know of the past - last state and last change - is carried
    over a summary with one row per element and slice.
    """
    part = ["element_id", "_slice"]
    order = F.struct("checked_at", "id")
    in_slice = Window.partitionBy(*part).orderBy("checked_at", "id")
    slices = Window.partitionBy("element_id").orderBy("_slice")

    rows = checks.withColumn("_slice", F.date_trunc(time_slice, "checked_at"))
    rows = rows.withColumn("_prev", F.lag("is_compliant").over(in_slice))
    summary = rows.groupBy(*part).agg(
        F.min_by("is_compliant", order).alias("_first"),
        F.min("checked_at").alias("_begin"),
        F.max_by("is_compliant", order).alias("_last"),
        F.max(F.when(F.col("_prev") != F.col("is_compliant"), F.col("checked_at"))).alias("_inner"),
    )
    summary = summary.withColumn("_before", F.lag("_last").over(slices))
    new_state = F.col("_before").isNull() | (F.col("_before") != F.col("_first"))
    summary = summary.withColumn(
        "_change", F.coalesce("_inner", F.when(new_state, F.col("_begin")))
    ).withColumn(
        "_since", F.max("_change").over(slices.rowsBetween(Window.unboundedPreceding, -1))
    ).select(*part, "_before", "_since")

    joined = rows.join(summary, part)
    before = F.coalesce("_prev", "_before")
    now = F.col("is_compliant")
    joined = joined.withColumn(
        "transition",
        F.when(before.isNull(), "first").when(before == now, "same").when(now, "fixed").otherwise("regressed"),
    )
    changed_at = F.when(F.col("transition") != "same", F.col("checked_at"))
    inside = F.max(changed_at).over(in_slice.rowsBetween(Window.unboundedPreceding, 0))
    since = F.coalesce(inside, "_since")
    seconds = F.timestamp_diff("SECOND", since, F.col("checked_at"))
    return joined.withColumn("days_in_state", F.floor(seconds / 86400).cast("int")).select(
        *checks.columns, "transition", "days_in_state"
    )
