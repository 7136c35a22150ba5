"""Connected components by alternating large and small stars, one checkpoint a step.

Every step replaces an edge by one that points to a smaller neighbour, so edges never outnumber the input.
Minima are aggregated before the shuffle; a hub's edges meet its one minimum in a join that adaptive
execution can split, because both sides are plain shuffles.

Edges are often few beside the corpus they come from, whose size sets the number of shuffle partitions.  So each step
runs in as many tasks as its edges need (``EDGES`` a task, two tasks a core at least): a step has some ten
stages, and each would leave its files and task events once a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


EDGES = 1 << 16


def _minima(edges: DataFrame, tasks: int) -> DataFrame:
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every end of an edge ``a, b``; null ends and loops say nothing."""
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        tasks = max(2 * edges.sparkSession.sparkContext.defaultParallelism, state[0] // EDGES + 1)
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both, tasks)
        large = cut_lineage(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
                            .coalesce(tasks).distinct().coalesce(tasks))
        low = _minima(large, tasks)
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.coalesce(tasks).unionByName(low.withColumnRenamed("m", "v")).distinct().coalesce(tasks))
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
