"""Summaries over checks and violations.  Every aggregate combines map-side, so a hot
project, rule or minute costs one partial row per task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline import schemas
from plumbline.operators.rules import EVALUATORS

# Fixed value: the message for an empty selection.
NOTHING_SELECTED = "Please select at least one element to check."


def batch_summary(checked: DataFrame) -> DataFrame:
    """One row ``checked, violations, message``, also for an empty selection.

    Every record counts as checked, also one without a spatial ``context``.
    """
    totals = checked.agg(
        F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum(F.size("violations")), F.lit(0)).alias("violations"),
    )
    found = F.concat(
        F.lit("Found "), F.col("violations").cast("string"), F.lit(" violation(s). See log for details.")
    )
    ending = F.when(F.col("violations") > 0, found).otherwise("All elements are compliant!")
    text = F.concat(F.lit("Checked "), F.col("checked").cast("string"), F.lit(" element(s).\n"), ending)
    return totals.select(
        "checked", "violations",
        F.when(F.col("checked") == 0, NOTHING_SELECTED).otherwise(text).alias("message"),
    )


def violations_per_check(results: DataFrame, key: str = "check_id") -> DataFrame:
    """Violation count from exploded result rows."""
    return results.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("violations_count"))


def project_analysis(checks: DataFrame, results: DataFrame, projects: DataFrame) -> DataFrame:
    """Checks, failures, violations and compliance rate per building type and project, with
    subtotals per building type and a grand total (``level`` 0 = project, 1 = type, 3 = all).
    Checks of a project without a type, or of none that is stored, count as ``unknown``.

    Both inputs are counted per project before they meet; the subtotals run on those counts.
    """
    done = checks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("is_compliant")).alias("failed"),
    )
    severities = [
        F.count_if(F.col("severity") == s).alias(s) for s in schemas.SEVERITIES
    ]
    found = results.groupBy("check_id").agg(*severities)
    found = found.join(checks.select(F.col("id").alias("check_id"), "project_id"), "check_id")
    found = found.groupBy("project_id").agg(*[F.sum(s).alias(s) for s in schemas.SEVERITIES])
    own = projects.select(F.col("id").alias("project_id"), "building_type")
    rows = done.join(found, "project_id", "left").join(own, "project_id", "left").fillna("unknown", ["building_type"])
    counted = rows.rollup("building_type", "project_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("checks").alias("checks"), F.sum("failed").alias("failed"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in schemas.SEVERITIES],
    )
    return counted.withColumn("compliance_rate", F.round(1 - F.col("failed") / F.col("checks"), 6))


def counted_elements(elements: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row with its count ``n`` for all elements that any rule judges alike (same types and measures, same ``keep``).

    Reports evaluate these in place of the elements, so counts are shuffled and not pairs.
    """
    alike = ["element_type", "building_type", *dict.fromkeys(e.measure for e in EVALUATORS.values()), *keep]
    return elements.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))


def compliance_report(violations: DataFrame) -> DataFrame:
    """Violations per rule and floor, one column per severity, and the total; ``n`` counts alike ones."""
    table = violations.groupBy("rule_id", "floor_level").pivot("severity", schemas.SEVERITIES).agg(F.sum("n"))
    columns = [F.coalesce(F.col(s), F.lit(0)) for s in schemas.SEVERITIES]
    return table.select(
        "rule_id", "floor_level",
        *[c.alias(s) for c, s in zip(columns, schemas.SEVERITIES)],
        reduce(lambda a, b: a + b, columns).alias("total"),
    )


def top_rules(violations: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` rules with most violations, ties by rule id; ``n`` counts alike ones."""
    counts = violations.groupBy("rule_id").agg(F.sum("n").alias("violations"))
    return counts.orderBy(F.desc("violations"), "rule_id").limit(k)


def latency_profile(requests: DataFrame, resolution: float = 0.01, q: float = 0.95) -> DataFrame:
    """Requests per minute and the exact ``q`` percentile of ``latency`` at a resolution.

    Latencies are counted per (minute, step) before the shuffle; the percentile is read off
    those counts, so no task ever holds the latencies of a minute.
    """
    step = F.round(F.col("latency") / F.lit(resolution)).cast("long")
    minute = F.date_trunc("minute", "ts")
    counts = requests.groupBy(minute.alias("minute"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("minute").orderBy("step")
    running = counts.withColumns({
        "below": F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("n").over(Window.partitionBy("minute")),
    })
    reached = F.col("below") >= F.ceil(F.col("total") * F.lit(q))
    return running.groupBy("minute").agg(
        F.max("total").alias("requests"),
        F.round(F.min(F.when(reached, F.col("step"))) * F.lit(resolution), 6).alias("latency_quantile"),
    )


def latency_sketch(requests: DataFrame, ts: Column, width: str = "1 minute", accuracy: float = 0.01) -> DataFrame:
    """Mergeable quantile sketch of ``latency`` per window: ``w, step, n``.

    A latency counts in the step whose bounds ``(g^(step-1), g^step]`` hold it, ``g = (1 + accuracy) / (1 - accuracy)``, so
    the middle of a step is within ``accuracy`` of every latency in it.  Latencies of zero or less have the
    null step, null ones and NaN are left out.  Sketches of windows merge by adding up ``n``; a window has as
    many rows as steps (900 from a microsecond to a minute at one percent), whatever its requests.
    """
    step = F.when(F.col("latency") > 0, F.ceil(F.ln("latency") / F.lit(math.log(_growth(accuracy)))))
    known = requests.filter(F.col("latency").isNotNull() & ~F.isnan("latency"))
    return known.groupBy(F.window(ts, width).alias("w"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, width: str = "1 hour") -> DataFrame:
    """Sketches of narrow windows as sketches of wider ones; in a stream a further aggregation."""
    return sketches.groupBy(F.window(F.window_time("w"), width).alias("w"), "step").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, qs: dict[str, float], accuracy: float = 0.01) -> DataFrame:
    """``window_start, requests`` and a column for each name in ``qs``: the quantile of a window, read off its steps.

    The value is the middle of the step that holds the ``ceil(q * requests)``-th latency, so within ``accuracy`` of
    it, and 0 where that latency is zero or less.  Take the ``accuracy`` of the sketch.
    """
    growth = _growth(accuracy)
    steps = sketches.groupBy("w").agg(
        F.sum("n").alias("requests"), F.sort_array(F.collect_list(F.struct("step", "n"))).alias("steps")
    )

    def quantile(q: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("step"), F.lit(False).alias("met"))
        rank = F.ceil(F.col("requests") * F.lit(q))

        def pass_step(state: Column, entry: Column) -> Column:
            below = state["below"] + entry["n"]
            step = F.when(state["met"], state["step"]).otherwise(entry["step"])
            return F.struct(below.alias("below"), step.alias("step"), (state["met"] | (below >= rank)).alias("met"))

        step = F.aggregate("steps", start, pass_step)["step"]
        return F.coalesce(F.lit(2 / (growth + 1)) * F.pow(F.lit(growth), step), F.lit(0.0))

    return steps.select(F.col("w.start").alias("window_start"), "requests", *[quantile(q).alias(name) for name, q in qs.items()])


def _growth(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError(f"accuracy must lie between 0 and 1: {accuracy}")
    return (1 + accuracy) / (1 - accuracy)


def rate_per_window(requests: DataFrame, ts: Column, width: str = "1 minute") -> DataFrame:
    """Requests per tumbling window; the same plan serves batch and stream."""
    return requests.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(
        F.col("w.start").alias("window_start"), "requests"
    )
