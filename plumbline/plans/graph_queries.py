"""Queries over the building graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graph
from plumbline.plans.registry import Inputs, query
from plumbline.session import cut_lineage


def _graph(t: Inputs) -> tuple[DataFrame, DataFrame]:
    parts = [("Building", t.buildings), ("Floor", t.floors), ("Room", t.graph_rooms)]
    parts += [(kind, t.hung.filter(F.col("kind") == kind).drop("kind")) for kind in ("Wall", "Door", "Window")]
    adjacent = graph.adjacent_rooms(t.rooms).select(
        F.concat(F.lit("R"), "room_a").alias("src"), F.concat(F.lit("R"), "room_b").alias("dst"))
    return graph.build_graph(parts, {"CONNECTS_TO": t.connections, "ADJACENT_TO": adjacent})


@query("graph_tables", """
    SELECT 'edge' AS part, src AS id, dst AS other, rel AS label FROM {edges}
    UNION ALL SELECT 'node', id, name, kind FROM {nodes}
""")
def graph_tables(t: Inputs) -> DataFrame:
    nodes, edges = _graph(t)
    return edges.select(
        F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other"), F.col("rel").alias("label")
    ).union(nodes.select(F.lit("node"), "id", "name", "kind"))


@query("neighbors", """
    SELECT s.src AS id, s.rel, s.dst AS neighbor, n.kind AS neighbor_kind FROM (
        SELECT src, dst, rel FROM {edges} WHERE rel = 'CONNECTS_TO'
        UNION ALL SELECT dst, src, rel FROM {edges} WHERE rel = 'CONNECTS_TO') s JOIN {nodes} n ON n.id = s.dst
""")
def neighbors(t: Inputs) -> DataFrame:
    return graph.neighbors(*_graph(t), "CONNECTS_TO", "both")


@query("containment_closure", """
    WITH RECURSIVE c AS (
        SELECT src AS ancestor, dst AS descendant, 1 AS depth FROM {contains}
        UNION ALL SELECT c.ancestor, e.dst, c.depth + 1 FROM c JOIN {contains} e ON e.src = c.descendant
    ) SELECT ancestor, descendant, depth FROM c
""")
def containment_closure(t: Inputs) -> DataFrame:
    return graph.containment_closure(_graph(t)[1])


@query("containment_intervals", """
    WITH RECURSIVE w AS (
        SELECT DISTINCT src AS id, CAST(NULL AS VARCHAR) AS parent, [src] AS way FROM {contains} WHERE src NOT IN (SELECT dst FROM {contains})
        UNION ALL SELECT e.dst, e.src, list_append(w.way, e.dst) FROM w JOIN {contains} e ON e.src = w.id
    ), s AS (
        SELECT id, count(*) AS size FROM (SELECT unnest(way) AS id FROM w) GROUP BY id
    )
    SELECT id, parent, CAST(len(way) - 1 AS INT) AS level, row_number() OVER (ORDER BY way) - 1 AS first,
           row_number() OVER (ORDER BY way) + size - 2 AS last
    FROM w JOIN s USING (id)
""")
def containment_intervals(t: Inputs) -> DataFrame:
    return graph.containment_intervals(_graph(t)[1])


@query("below_by_interval", """
    WITH RECURSIVE c AS (
        SELECT src AS ancestor, dst AS descendant, 1 AS depth FROM {contains}
        UNION ALL SELECT c.ancestor, e.dst, c.depth + 1 FROM c JOIN {contains} e ON e.src = c.descendant
    ) SELECT ancestor, descendant, depth FROM c
""")
def below_by_interval(t: Inputs) -> DataFrame:
    labels = cut_lineage(graph.containment_intervals(_graph(t)[1]))
    return graph.below(labels, labels)


@query("containment_path", """
    SELECT d.id, d.kind, r.id AS room, f.id AS floor, coalesce(f.parent, b.id) AS building
    FROM {hung} d LEFT JOIN {graph_rooms} r ON r.id = d.parent LEFT JOIN {floors} f ON f.id = coalesce(r.parent, d.parent)
    LEFT JOIN {buildings} b ON b.id = d.parent
""")
def containment_path(t: Inputs) -> DataFrame:
    return graph.containment_path(*_graph(t))


@query("reachability", """
    WITH RECURSIVE ways AS (
        SELECT src, dst FROM {connections} UNION ALL SELECT dst, src FROM {connections}
    ), b(id, hops) USING KEY (id) AS (
        SELECT id, 0 FROM {exits}
        UNION SELECT w.dst, min(b.hops) + 1 FROM b JOIN ways w ON w.src = b.id
        LEFT JOIN recurring.b AS r ON r.id = w.dst WHERE r.id IS NULL GROUP BY w.dst
    )
    SELECT r.id, min(b.hops) AS hops FROM {graph_rooms} r LEFT JOIN b ON b.id = r.id GROUP BY r.id
""")
def reachability(t: Inputs) -> DataFrame:
    return graph.reachability(*_graph(t), t.exits)


@query("part_of", "SELECT dst AS src, src AS dst, 'PART_OF' AS rel FROM {contains}")
def part_of(t: Inputs) -> DataFrame:
    return graph.part_of(_graph(t)[1])


@query("part_of_mismatches", """
    SELECT src, dst, 'PART_OF' AS missing FROM {contains} WHERE src LIKE 'B%' AND dst NOT LIKE 'D%'
    UNION ALL SELECT src, dst, 'CONTAINS' FROM {contains} WHERE src NOT LIKE 'B%' AND dst LIKE 'D%'
""")
def part_of_mismatches(t: Inputs) -> DataFrame:
    edges = _graph(t)[1]
    lost = (F.col("rel") == "PART_OF") & F.col("dst").startswith("B")
    lost |= (F.col("rel") == "CONTAINS") & F.col("dst").startswith("D")
    return graph.part_of_mismatches(edges.filter(~lost))


@query("adjacent_rooms", """
    SELECT a.level_id, a.room_id AS room_a, b.room_id AS room_b FROM {rooms} a JOIN {rooms} b
    ON a.level_id = b.level_id AND a.room_id < b.room_id AND (
        ((a.x1 = b.x0 OR b.x1 = a.x0) AND greatest(a.y0, b.y0) < least(a.y1, b.y1))
        OR ((a.y1 = b.y0 OR b.y1 = a.y0) AND greatest(a.x0, b.x0) < least(a.x1, b.x1)))
""")
def adjacent_rooms(t: Inputs) -> DataFrame:
    return graph.adjacent_rooms(t.rooms)
