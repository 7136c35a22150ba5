"""Derived inputs: building records read off the given tables.

One SQL text per view serves Spark and the checking engine.  ``{name}`` is a given table or
another view.  All rows of the tables are used.
"""

from __future__ import annotations

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _category(key: str) -> str:
    return (
        f"CASE {key} % 7 WHEN 0 THEN 'Wall' WHEN 1 THEN 'Corridor' WHEN 2 THEN 'Door' "
        "WHEN 3 THEN 'Window' WHEN 4 THEN 'Floor' WHEN 5 THEN 'Stairs' END"
    )


def _kind(key: str) -> str:
    return f"CASE WHEN {key} % 7 = 0 THEN 'wall' WHEN {key} % 7 IN (2, 3, 5) THEN 'family' ELSE 'other' END"


def _room(key: str) -> str:
    return f"CASE {key} % 4 WHEN 0 THEN 'Corridor' WHEN 1 THEN 'Office' WHEN 2 THEN 'corridor' END"


_ELEMENT_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

_ELEMENT = f"""
    {_ELEMENT_ID} AS element_id,
    {_category('l_partkey')} AS category,
    coalesce({_category('l_partkey')}, 'Unknown') AS element_type,
    l_quantity / 8.0 AS width_ft,
    CASE WHEN l_discount < 0.02 THEN NULL ELSE l_tax * 100 + 6.0 END AS height_ft,
    l_quantity / 8.0 * CAST(304.8 AS DOUBLE) AS width_mm,
    CASE WHEN l_discount < 0.02 THEN NULL ELSE (l_tax * 100 + 6.0) * CAST(304.8 AS DOUBLE) END AS height_mm,
    l_returnflag <> 'R' AS has_context,
    {_room('l_suppkey')} AS room_type,
    CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 401 AS INT) END AS occupancy,
    CAST(l_suppkey % 25 AS INT) AS level_id
"""

_RULE = f"""
        SELECT p_partkey AS id, concat('R', p_partkey) AS rule_id,
               CASE p_size % 3 WHEN 0 THEN 'min_width' WHEN 1 THEN 'max_height' ELSE 'fire_rating' END AS rule_type,
               coalesce(lower({_category('p_partkey')}), 'room') AS geometry_type,
               split(CASE p_type WHEN 'ECONOMY' THEN 'residential' WHEN 'SMALL' THEN 'residential,office'
                                 WHEN 'MEDIUM' THEN 'office' WHEN 'LARGE' THEN 'hospital,office'
                                 WHEN 'PROMO' THEN 'hospital' END, ',') AS building_types,
               p_name AS title, concat(p_type, ' ', p_name) AS description,
               concat('Section ', p_size) AS code_reference,
               p_size * CAST(40.0 AS DOUBLE) AS value_mm,
               CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' ELSE 'warning' END AS severity,
               CASE p_partkey % 3 WHEN 0 THEN 'en' ELSE 'cs' END AS language,
               p_brand AS version, p_brand = 'Brand#1' AS is_active
"""

VIEWS = {
    # check records; the second form adds what the order knows
    "elements": f"SELECT {_ELEMENT} FROM {{lineitem}}",
    "project_elements": f"""
        SELECT {_ELEMENT_ID} AS id,
               o_custkey AS project_id, o_orderdate AS stamp, {_ELEMENT}
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
    """,
    # model elements before extraction
    "raw_elements": f"""
        SELECT {_ELEMENT_ID} AS element_id,
               {_category('l_partkey')} AS category, {_kind('l_partkey')} AS kind,
               l_quantity / 8.0 AS wall_width,
               CASE WHEN l_discount < 0.02 THEN NULL ELSE l_tax * 100 + 6.0 END AS wall_height,
               CASE l_linestatus WHEN 'F' THEN 'Interior' ELSE 'Exterior' END AS wall_function,
               concat('Family ', l_returnflag) AS family_name,
               CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 8.0 END AS width_en,
               CASE WHEN l_linenumber % 3 < 2 THEN l_quantity / 16.0 END AS width_cs,
               CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 100 + 6.0 END AS height_en,
               CASE WHEN l_linenumber % 4 < 2 THEN l_tax * 50 + 6.0 END AS height_cs,
               CASE l_linestatus WHEN 'F' THEN 'point' ELSE 'curve' END AS location_kind,
               CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_orderkey % 100 AS DOUBLE) AS y,
               CAST(l_suppkey % 30 AS INT) AS level_id, l_returnflag <> 'N' AS has_level_param
        FROM {{lineitem}}
    """,
    # request texts: valid, coerced, refused and broken ones (chr(123), chr(125) are braces)
    "request_texts": f"""
        SELECT element_id, CASE l_linenumber WHEN 5 THEN left(body, length(body) - 1) ELSE body END AS json FROM (
            SELECT element_id, l_linenumber, chr(123) ||
                CASE WHEN l_linenumber = 4 THEN ''
                     WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN '"element_type": 5, '
                     ELSE '"element_type": "' || element_type || '", ' END ||
                CASE WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN ''
                     ELSE '"properties": ' || chr(123) || '"width_mm": ' ||
                         CASE l_linenumber WHEN 1 THEN 'null' WHEN 2 THEN '"' || width_mm || '"'
                              ELSE CAST(width_mm AS VARCHAR(30)) END ||
                         coalesce(', "height_mm": ' || height_mm, '') || chr(125) || ', ' END ||
                '"context": ' ||
                CASE WHEN l_linenumber = 6 THEN 'null'
                     ELSE chr(123) || '"room_type": ' || coalesce('"' || room_type || '"', 'null') || ', "occupancy": ' ||
                         CASE l_linenumber WHEN 3 THEN '250.5' WHEN 7 THEN '"250"'
                              ELSE coalesce(CAST(occupancy AS VARCHAR(9)), 'null') END || chr(125) END ||
                chr(125) AS body
            FROM (SELECT l_linenumber, l_returnflag, {_ELEMENT} FROM {{lineitem}}) e) t
    """,
    "levels": """
        SELECT n_nationkey AS level_id,
               CASE n_regionkey WHEN 0 THEN n_name WHEN 1 THEN concat(' ', n_nationkey, ' ')
                                WHEN 2 THEN concat('Level ', n_nationkey) WHEN 3 THEN 'Ground floor'
                                ELSE 'SECOND' END AS name
        FROM {nation}
    """,
    "rooms": f"""
        SELECT s_suppkey AS room_id, CAST(floor(s_suppkey / 10) AS INT) % 25 AS level_id,
               {_room('s_suppkey')} AS name,
               CAST(s_suppkey % 5 * 20 AS DOUBLE) AS x0, CAST(s_suppkey % 5 * 20 + 20 AS DOUBLE) AS x1,
               CAST(floor(s_suppkey % 10 / 5) * 50 AS DOUBLE) AS y0,
               CAST(floor(s_suppkey % 10 / 5) * 50 + 50 AS DOUBLE) AS y1
        FROM {{supplier}}
    """,
    # the relational tables, with some faults for the integrity reports; the rule catalogue has one rule for
    # each kind, size and geometry of part, so that it stays a catalogue however many parts there are
    "users": """
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               CASE n_regionkey WHEN 1 THEN NULL WHEN 2 THEN 'shared@example.com'
                                ELSE concat(lower(n_name), '@example.com') END AS email,
               CASE WHEN n_regionkey = 3 THEN NULL ELSE concat('hash-', n_nationkey) END AS hashed_password,
               n_name AS full_name
        FROM {nation}
    """,
    "projects": """
        SELECT c_custkey AS id,
               CAST(CASE WHEN c_acctbal < 0 THEN c_nationkey + 100 ELSE c_nationkey END AS BIGINT) AS user_id,
               c_name AS name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'office' WHEN 'MACHINERY' THEN 'hospital'
                                 WHEN 'AUTOMOBILE' THEN NULL ELSE 'residential' END AS building_type
        FROM {customer}
    """,
    # a catalogue whose size hardly grows with the elements, and one with a rule for every part
    "rules": f"""{_RULE}
        FROM (SELECT min(p_partkey) AS p_partkey, p_type, p_size, min_by(p_name, p_partkey) AS p_name, min_by(p_brand, p_partkey) AS p_brand
              FROM {{part}} GROUP BY p_type, p_size, p_partkey % 7) p
    """,
    "part_rules": f"{_RULE} FROM {{part}}",
    # change feed, check history and request log
    "changes": f"""
        SELECT event_id AS id, user_id AS element_id, ts,
               CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type,
               {_category('user_id')} AS category, {_kind('user_id')} AS kind,
               CASE WHEN value < 1 THEN NULL ELSE value / 10.0 END AS wall_width,
               CAST(NULL AS DOUBLE) AS wall_height, 'Interior' AS wall_function, event_type AS family_name,
               CASE WHEN value >= 20 THEN value / 10.0 END AS width_en,
               CASE WHEN value < 20 THEN value / 5.0 END AS width_cs,
               {_room('user_id')} AS room_type, CAST(event_id % 401 AS INT) AS occupancy,
               CAST(user_id % 5 AS INT) AS floor_level
        FROM {{events}}
    """,
    "history": """
        SELECT event_id AS id, user_id AS element_id, ts AS checked_at,
               value / 10.0 * CAST(304.8 AS DOUBLE) >= 1200 AS is_compliant
        FROM {events}
    """,
    "cache_requests": """
        SELECT event_id AS request_id, concat(event_type, '/', user_id % 3) AS cache_key, ts, value AS latency
        FROM {events}
    """,
    # documents and vectors
    "docs": "SELECT doc_id, source AS source_document, lang AS language, text FROM {documents}",
    "rule_texts": """
        SELECT p_partkey AS chunk_id, concat('Section ', p_size, '.', p_size % 9, '(a) ',
               CASE p_size % 4
                    WHEN 0 THEN concat('minimum clear width is ', p_retailprice, ' mm. See also part ', p_partkey, '.')
                    WHEN 1 THEN concat('šířka nejvýše ', p_size * 50, ' mm; výška nejméně ', p_size * 10, ',5 mm')
                    WHEN 2 THEN concat('drawing of ', p_name, ' at 300 mm')
                    ELSE concat(p_name, ' at least ', p_size, ' mm and ', p_size * 2, ' mm! At most 7 mm?') END) AS text
        FROM {part}
    """,
    "vectors": """
        SELECT vec_id AS chunk_id, embedding,
               CASE label % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'corridor' ELSE 'door' END AS geometry_type,
               CASE vec_id % 2 WHEN 0 THEN 'cs' ELSE 'en' END AS language,
               split(CASE label % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'residential,office'
                                    WHEN 2 THEN 'office' END, ',') AS building_types,
               CASE vec_id % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'office' END AS building_type
        FROM {embeddings}
    """,
    # building graph: regions are buildings, nations floors, customers rooms, suppliers doors
    "buildings": "SELECT concat('B', r_regionkey) AS id, r_name AS name, CAST(NULL AS VARCHAR(9)) AS parent FROM {region}",
    "floors": "SELECT concat('F', n_nationkey) AS id, n_name AS name, concat('B', n_regionkey) AS parent FROM {nation}",
    "graph_rooms": "SELECT concat('R', c_custkey) AS id, c_name AS name, concat('F', c_nationkey) AS parent FROM {customer}",
    # walls, doors and windows hang on rooms, some on floors or buildings, one in 13 on nothing
    "hung": """
        SELECT concat(CASE s_suppkey % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'N' ELSE 'D' END, s_suppkey) AS id,
               CASE s_suppkey % 4 WHEN 0 THEN 'Wall' WHEN 1 THEN 'Window' ELSE 'Door' END AS kind, s_name AS name,
               CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN concat('B', s_suppkey % 5)
                    WHEN s_suppkey % 7 = 0 THEN concat('F', s_nationkey) ELSE concat('R', s_suppkey) END AS parent
        FROM {supplier}
    """,
    "connections": """
        SELECT concat('R', a.c_custkey) AS src, concat('R', b.c_custkey) AS dst
        FROM {customer} a JOIN {customer} b ON b.c_custkey = CAST(floor(a.c_custkey / 2) AS BIGINT)
        WHERE a.c_custkey > 0
    """,
    "exits": "SELECT concat('R', c_custkey) AS id FROM {customer} WHERE c_acctbal < -900",
}

# ``project_elements`` with what the order's project knows, from orders that have it already
PLACED = f"""
    SELECT {_ELEMENT_ID} AS id,
           project_id, o_orderdate AS stamp, {_ELEMENT}, project_name, building_type
    FROM {{lineitem}} JOIN {{placed_orders}} ON l_orderkey = o_orderkey
"""
