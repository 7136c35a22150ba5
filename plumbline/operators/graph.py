"""Building graph as ``nodes(id, kind, name)`` and ``edges(src, dst, rel)``.

Traversals are frontier joins: each round joins the frontier (distinct nodes) with the
edges and is checkpointed to the shared folder, so neither lineage nor a lost executor
grows the work.  Hot nodes are split by adaptive skew handling, as they sit on the edge side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.enrich import cell_size
from plumbline.session import cut_lineage

# Kinds and relations of the graph.
KINDS = ["Building", "Floor", "Room", "Wall", "Door", "Window"]
RELATIONS = ["CONTAINS", "CONNECTS_TO", "ADJACENT_TO", "PART_OF"]


def build_graph(parts: list[tuple[str, DataFrame]], links: dict[str, DataFrame] | None = None,
                ) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` from part tables and further links.

    Each part is ``(kind, df)`` with ``id, name`` and ``parent`` (null at the top): it gives
    a node, a CONTAINS edge and its PART_OF inverse.  ``links`` maps a relation to
    ``src, dst`` rows.
    """
    for kind, _ in parts:
        if kind not in KINDS:
            raise ValueError(f"unknown node kind: {kind}")
    for rel in links or {}:
        if rel not in RELATIONS:
            raise ValueError(f"unknown relation: {rel}")
    nodes = [df.select("id", F.lit(kind).alias("kind"), "name") for kind, df in parts]
    edges = []
    for _, df in parts:
        held = df.filter(F.col("parent").isNotNull())
        pairs = F.array(
            F.struct(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("rel")),
            F.struct(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("PART_OF").alias("rel")),
        )
        edges.append(held.select(F.inline(pairs)))
    edges += [df.select("src", "dst", F.lit(rel).alias("rel")) for rel, df in (links or {}).items()]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def neighbors(nodes: DataFrame, edges: DataFrame, rel: str | None = None, direction: str = "out") -> DataFrame:
    """``id, rel, neighbor, neighbor_kind`` along a relation, ``out``, ``in`` or ``both``."""
    picked = edges if rel is None else edges.filter(F.col("rel") == rel)
    out = picked.select(F.col("src").alias("id"), "rel", F.col("dst").alias("neighbor"))
    back = picked.select(F.col("dst").alias("id"), "rel", F.col("src").alias("neighbor"))
    pairs = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    known = nodes.select(F.col("id").alias("neighbor"), F.col("kind").alias("neighbor_kind"))
    return pairs.join(known, "neighbor").join(nodes.select("id"), "id").select(
        "id", "rel", "neighbor", "neighbor_kind"
    )


def containment_closure(edges: DataFrame) -> DataFrame:
    """``ancestor, descendant, depth`` along CONTAINS, to any depth.  A cycle (a node below itself) is an error."""
    # read once: every round joins it
    child = cut_lineage(edges.filter("rel = 'CONTAINS'").select(
        F.col("src").alias("descendant"), F.col("dst").alias("_next")
    ))
    level = child.select(F.col("descendant").alias("ancestor"), F.col("_next").alias("descendant"))
    level = cut_lineage(level.withColumn("depth", F.lit(1)))
    found = [level]
    while not level.isEmpty():
        if not level.filter("ancestor = descendant").isEmpty():
            raise ValueError("a node contains itself")
        level = cut_lineage(level.join(child, "descendant").select(
            "ancestor", F.col("_next").alias("descendant"), (F.col("depth") + 1).alias("depth")
        ))
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def containment_intervals(edges: DataFrame) -> DataFrame:
    """Nested-set labels of the CONTAINS forest: ``id, parent, level, first, last``.

    ``first`` numbers the nodes from 0, every node before what it holds and siblings by id; ``first`` to ``last`` are a node and all below it,
    so a subtree is a range of ``first`` (see ``below``).  ``parent`` is null and ``level`` 0 at the top.  Repeated
    edges count once, edges with a null end are left out; a node below itself or with two parents is an error.

    Way up by doubling: each round joins what a node knows of its way to what the end of that way knows, so
    there are as many rounds as the depth has binary digits.  Rows hold their way, together as large as the closure.
    """
    up = cut_lineage(edges.filter("rel = 'CONTAINS' AND src IS NOT NULL AND dst IS NOT NULL").select(
        F.col("dst").alias("id"), F.col("src").alias("end")
    ).distinct())
    if not up.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("a node hangs on two parents")
    tops = up.select(F.col("end").alias("id")).distinct().join(up, "id", "left_anti").withColumn("end", F.lit(None).cast("string"))
    ways = cut_lineage(up.unionByName(tops).withColumn("way", F.array("id")))
    while not ways.filter("end IS NOT NULL").isEmpty():
        if not ways.filter("array_contains(way, end)").isEmpty():
            raise ValueError("a node contains itself")
        above = ways.select(F.col("id").alias("end"), F.col("end").alias("_end"), F.col("way").alias("_way"))
        longer = ways.filter("end IS NOT NULL").join(above, "end").select(
            "id", F.col("_end").alias("end"), F.concat("_way", "way").alias("way")
        )
        ways = cut_lineage(ways.filter("end IS NULL").unionByName(longer))

    # ways in order are nodes in order; row numbers of range partitions are moved by what lies before the partition
    placed = cut_lineage(ways.select("id", "way").repartitionByRange("way").sortWithinPartitions("way").withColumn(
        "_at", F.monotonically_increasing_id()
    )).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    sizes = ways.select(F.explode("way").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_size"))
    first = F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(offsets, "_part").join(sizes, "id").select(
        "id", F.get("way", F.size("way") - 2).alias("parent"), (F.size("way") - 1).alias("level"),
        first.alias("first"), (first + F.col("_size") - 1).alias("last"),
    )


def below(labels: DataFrame, holders: DataFrame, piece: int = 4096) -> DataFrame:
    """``ancestor, descendant, depth`` of all nodes below ``holders(id)``, by their labels.

    Ranges are told as the numbers in them, one row a result, which meet the nodes by number: an equi join without
    a hot key or a candidate in vain, and one shuffle of nodes whatever their depth.  A range is dealt in
    pieces, so no task tells a large one alone.
    """
    ranges = holders.select("id").distinct().join(labels, "id").filter("last > first")
    pieces = ranges.select(
        F.col("id").alias("ancestor"), F.col("level").alias("_level"), "last",
        F.explode(F.sequence(F.col("first") + 1, F.col("last"), F.lit(piece).cast("long"))).alias("_from"),
    ).repartition("_from", "ancestor")
    numbers = pieces.select("ancestor", "_level", F.explode(
        F.sequence("_from", F.least(F.col("_from") + piece - 1, "last"))
    ).alias("first"))
    nodes = labels.select("first", F.col("id").alias("descendant"), "level")
    return numbers.join(nodes, "first").select("ancestor", "descendant", (F.col("level") - F.col("_level")).alias("depth"))


def containment_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, kind, room, floor, building`` of each element; null where it hangs on none, as on a floor."""
    up = edges.filter("rel = 'CONTAINS'")

    def parents(child: str, parent: str) -> DataFrame:
        return up.select(F.col("dst").alias(child), F.col("src").alias(parent))

    # floor and building of each room, floor and building first: that side is small, elements come last
    def only(kind: str) -> DataFrame:
        return nodes.filter(F.col("kind") == kind)

    floors = only("Floor").select(F.col("id").alias("floor")).join(parents("floor", "building"), "floor", "left")
    rooms = only("Room").select(F.col("id").alias("room")).join(parents("room", "floor"), "room", "left").join(floors, "floor", "left")
    none = F.lit(None).cast("string")
    holders = reduce(DataFrame.unionByName, [
        rooms.select(F.col("room").alias("holder"), "room", "floor", "building"),
        floors.select(F.col("floor").alias("holder"), none.alias("room"), "floor", "building"),
        only("Building").select(F.col("id").alias("holder"), none.alias("room"), none.alias("floor"), F.col("id").alias("building")),
    ])
    elements = nodes.filter(F.col("kind").isin("Wall", "Door", "Window")).select("id", "kind")
    return elements.join(parents("id", "holder"), "id", "left").join(holders, "holder", "left").select(
        "id", "kind", "room", "floor", "building"
    )


def reachability(nodes: DataFrame, edges: DataFrame, exits: DataFrame) -> DataFrame:
    """Fewest CONNECTS_TO hops, either way, from ``exits(id)`` to each room; null where there is no way."""
    link = edges.filter("rel = 'CONNECTS_TO'")
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # read once: every round joins it
    ways = cut_lineage(link.select(F.inline(ends)))
    level = cut_lineage(exits.select("id").distinct().withColumn("hops", F.lit(0)))
    found = [level]
    while not level.isEmpty():
        # a node next to the frontier is new or in one of the last two levels
        recent = reduce(DataFrame.unionByName, found[-2:]).select("id")
        following = ways.join(level.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        level = cut_lineage(following.join(recent, "id", "left_anti").withColumn("hops", F.lit(len(found))))
        found.append(level)
    reached = reduce(DataFrame.unionByName, found)
    return nodes.filter("kind = 'Room'").select("id").join(reached, "id", "left")


def part_of_mismatches(edges: DataFrame) -> DataFrame:
    """CONTAINS edges without their PART_OF inverse and the reverse: ``src, dst, missing``."""
    down = edges.filter("rel = 'CONTAINS'").select("src", "dst")
    up = edges.filter("rel = 'PART_OF'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return down.join(up, ["src", "dst"], "left_anti").withColumn("missing", F.lit("PART_OF")).unionByName(
        up.join(down, ["src", "dst"], "left_anti").withColumn("missing", F.lit("CONTAINS"))
    )


def part_of(edges: DataFrame) -> DataFrame:
    """PART_OF edges derived as the inverse of CONTAINS."""
    return edges.filter("rel = 'CONTAINS'").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("PART_OF").alias("rel")
    )


def adjacent_rooms(rooms: DataFrame) -> DataFrame:
    """Unordered pairs ``a < b`` of rooms on one level whose boxes share part of an edge.

    The equi key is the line of the shared edge plus a cell along it (as long as the median room): one room's far side
    meets another's near side.  A pair is emitted only in the cell where the shared part
    begins, so no distinct is needed.
    """
    cell = F.col("_size")
    solid = rooms.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).withColumn("_size", cell_size(rooms))

    def sides(low: str, high: str, across: tuple[str, str], axis: str, name: str) -> DataFrame:
        a, b = across
        first = F.floor(F.col(a) / cell).cast("long")
        cells = F.sequence(first, F.greatest(first, (F.ceil(F.col(b) / cell) - 1).cast("long")))
        edge = F.col(high) if name == "far" else F.col(low)
        return solid.select(
            "level_id", F.lit(axis).alias("axis"), edge.alias("line"), F.explode(cells).alias("cell"),
            F.col("room_id").alias(f"{name}_id"), F.col(a).alias(f"{name}_lo"), F.col(b).alias(f"{name}_hi"),
            F.col("_size").alias(f"{name}_size"),
        )

    def both(name: str) -> DataFrame:
        vertical = sides("x0", "x1", ("y0", "y1"), "x", name)
        return vertical.unionByName(sides("y0", "y1", ("x0", "x1"), "y", name))

    begin = F.greatest("far_lo", "near_lo")
    touching = begin < F.least("far_hi", "near_hi")
    first_cell = F.floor(begin / F.col("far_size")).cast("long") == F.col("cell")
    pairs = both("far").join(both("near"), ["level_id", "axis", "line", "cell"]).filter(
        touching & first_cell & (F.col("far_id") != F.col("near_id"))
    )
    return pairs.select(
        "level_id", F.least("far_id", "near_id").alias("room_a"), F.greatest("far_id", "near_id").alias("room_b")
    )
