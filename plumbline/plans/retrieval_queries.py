"""Queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import distinct_tokens
from plumbline.functions.vectors import cosine
from plumbline.operators import retrieval, rules, vector_store
from plumbline.plans.registry import Inputs, query
from plumbline.session import cut_lineage, scratch_path

# No two of the given vectors reach the default threshold.
MIN_SCORE = 0.2
# What ``fit_probing`` asks for on the given vectors, which have no clusters.
PROBING = retrieval.Probing(cells=1.0, scored=0.1)


def _asked(t: Inputs) -> DataFrame:
    """Every vector asks for its neighbours."""
    return t.vectors.withColumnRenamed("chunk_id", "query_id")


@query("ingest_documents", """
    SELECT doc_id, source_document, language, CAST(1 AS INT) + CAST(i AS INT) AS page_number, pages[i + 1] AS text
    FROM (SELECT *, unnest(range(len(pages))) AS i FROM (SELECT *, string_split(text, chr(12)) AS pages FROM {docs}) d) p
""")
def ingest_documents(t: Inputs) -> DataFrame:
    return retrieval.ingest(t.docs)


@query("chunk_text", "SELECT doc_id, source_document, language, chunk_index, text FROM {chunks}")
def chunk_text(t: Inputs) -> DataFrame:
    return retrieval.chunk(t.docs)


def _weights_sql(rows: str, key: str, corpus: str | None = None, corpus_key: str | None = None) -> str:
    """Hashed TF-IDF of ``rows`` (key columns, text), fitted to ``corpus``: the place is the first 12 hex digits of a token's md5."""
    counts = """
        SELECT KEY, CAST(('0x' || md5(token)[1:12])::BIGINT % DIM AS INT) AS place, count(*) AS n
        FROM (SELECT KEY, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS token
              FROM (ROWS) w0) w1 GROUP BY ALL""".replace("DIM", str(retrieval.DIMENSION))
    base = corpus or rows
    return """
        SELECT KEY, place, raw / sqrt(sum(raw * raw) OVER (PARTITION BY KEY)) AS weight FROM (
            SELECT KEY, c.place, c.n * i.idf AS raw FROM (OWN) c JOIN (
                SELECT place, ln(((SELECT count(text) FROM (BASE) w2) + 1)::DOUBLE / (count(*) + 1)::DOUBLE) AS idf
                FROM (COUNTED) d GROUP BY place) i ON i.place = c.place) r WHERE raw <> 0
    """.replace("OWN", counts.replace("ROWS", rows)).replace("COUNTED", counts.replace("ROWS", base).replace("KEY", corpus_key or key)).replace("BASE", base).replace("KEY", key)


_CHUNK_WEIGHTS = _weights_sql("SELECT doc_id, chunk_index, text FROM {chunks}", "doc_id, chunk_index")


@query("embed_chunks", f"""
    SELECT c.doc_id, c.chunk_index, CAST({retrieval.DIMENSION} AS INT) AS dimension, coalesce(w.vector, '') AS vector
    FROM {{chunks}} c LEFT JOIN (
        SELECT doc_id, chunk_index, string_agg(concat(place, ':', CAST(round(weight * 10000) AS BIGINT)), ' ' ORDER BY place) AS vector
        FROM ({_CHUNK_WEIGHTS}) v GROUP BY doc_id, chunk_index) w ON w.doc_id = c.doc_id AND w.chunk_index = c.chunk_index
""")
def embed_chunks(t: Inputs) -> DataFrame:
    """Whole vectors, as the places that are not zero and their weights in ten-thousandths."""
    found = retrieval.token_places("text", retrieval.DIMENSION).alias("places")
    chunks = cut_lineage(retrieval.chunk(t.docs).select("doc_id", "chunk_index", found))
    made = retrieval.fit_embedder(chunks, places=F.col("places")).weights(chunks, places=F.col("places"))
    spelt = F.transform("weights", lambda r: F.concat(r["place"].cast("string"), F.lit(":"), F.round(r["weight"] * 10000).cast("long").cast("string")))
    return made.select("doc_id", "chunk_index", F.lit(retrieval.DIMENSION).alias("dimension"), F.array_join(spelt, " ").alias("vector"))


_SPELT = "array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ' ')"


_UPSERTED = f"""
    SELECT chunk_id, CASE WHEN label <= 4 THEN 'new' ELSE 'old' END AS state, language, {_SPELT.replace('embedding', 'v.embedding')} AS vector
    FROM {{vectors}} v JOIN embeddings ON vec_id = chunk_id
    UNION ALL SELECT chunk_id + 1000000, 'new', language, {_SPELT.replace('embedding', 'v.embedding')}
    FROM {{vectors}} v JOIN embeddings ON vec_id = chunk_id WHERE label <= 4
"""


def _old_and_new(t: Inputs) -> tuple[DataFrame, DataFrame]:
    stored = t.vectors.select("chunk_id", F.lit("old").alias("state"), "language", "embedding")
    low = t.vectors.join(t.embeddings.filter("label <= 4").select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_semi")
    new = low.select(
        F.explode(F.array(F.col("chunk_id"), F.col("chunk_id") + 1000000)).alias("chunk_id"),
        F.lit("new").alias("state"), "language", "embedding",
    )
    return stored, new


def _spelt(vectors: DataFrame) -> DataFrame:
    spelt = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return vectors.select("chunk_id", "state", "language", F.array_join(spelt, " ").alias("vector"))


@query("vector_table", _UPSERTED)
def vector_table(t: Inputs) -> DataFrame:
    stored, new = _old_and_new(t)
    return _spelt(retrieval.upsert_vectors(stored, new))


@query("vector_store", _UPSERTED)
def stored_vectors(t: Inputs) -> DataFrame:
    """The same through the stored table: a load, an upsert and its replay."""
    path, (stored, new) = scratch_path(t.spark, "vectors"), _old_and_new(t)
    for batch, rows in ((0, stored), (1, new), (1, new)):
        vector_store.upsert(rows, batch, path)
    return _spelt(vector_store.read_vectors(t.spark, path))


@query("cosine_similarity", """
    SELECT a.chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM {vectors} a JOIN {vectors} b ON b.chunk_id = a.chunk_id + 1
""")
def cosine_similarity(t: Inputs) -> DataFrame:
    following = t.vectors.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("next"))
    return t.vectors.join(following, "chunk_id").select(
        "chunk_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("score")
    )


_TOP = """
    SELECT query_id, chunk_id, score, CAST(i AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM {{pair_scores}} {where}) r
    WHERE i <= {k}
"""


@query("knn_join", _TOP.format(where="", k=5))
def knn_join(t: Inputs) -> DataFrame:
    return retrieval.knn_join(t.vectors, _asked(t), 5, MIN_SCORE, skip_self=True)


@query("vector_search", _TOP.format(where="", k=10))
def vector_search(t: Inputs) -> DataFrame:
    return retrieval.vector_search(t.vectors, _asked(t), 10, MIN_SCORE, skip_self=True)


@query("filtered_search", _TOP.format(k=5, where="""
    WHERE q_geometry = c_geometry AND q_language = c_language
      AND (building_types IS NULL OR list_contains(building_types, building_type))"""))
def filtered_search(t: Inputs) -> DataFrame:
    return retrieval.filtered_search(t.vectors, _asked(t), 5, MIN_SCORE, skip_self=True)


# Projections on planes of +1 and -1 and the sides of chunks; each query scores the tenth of the index nearest by code.
# Written for tables of one cell, which those of at most ``BLOCK_ROWS`` vectors are.
_CODES = f"""
    SELECT chunk_id, list(m ORDER BY b) AS margins, list(CASE WHEN m >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY b) AS sides FROM (
        SELECT v.chunk_id, p.b, sum(CASE WHEN p.up THEN x ELSE -x END) AS m
        FROM (SELECT chunk_id, unnest(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))) AS x, unnest(range(len(e))) AS d
              FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM {{vectors}})) v
        JOIN (SELECT b, d, md5(concat('42:', b, ':', d))[1] < '8' AS up
              FROM range({PROBING.planes}) q(b), (SELECT DISTINCT unnest(range(len(embedding))) AS d FROM {{vectors}}) e) p ON p.d = v.d
        GROUP BY v.chunk_id, p.b) s GROUP BY chunk_id
"""


@query("approx_search", f"""
    SELECT query_id, chunk_id, score, CAST(i AS INT) AS rank FROM (
        SELECT s.query_id, s.chunk_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.chunk_id) AS i
        FROM {{pair_scores}} s JOIN (
            SELECT query_id, chunk_id FROM (
                SELECT a.chunk_id AS query_id, b.chunk_id, rank() OVER (
                           PARTITION BY a.chunk_id ORDER BY round(list_inner_product(a.margins, b.sides), 6) DESC) AS place
                FROM ({_CODES}) a JOIN ({_CODES}) b ON a.chunk_id <> b.chunk_id) n
            WHERE place <= ceil({PROBING.scored} * (SELECT count(*) FROM {{vectors}}))) c
        ON c.query_id = s.query_id AND c.chunk_id = s.chunk_id) r
    WHERE i <= 5
""")
def approx_search(t: Inputs) -> DataFrame:
    return retrieval.approx_search(t.vectors, _asked(t), 5, MIN_SCORE, PROBING, skip_self=True)


# neighbouring vectors and their scores, as found by an earlier search
_NEAR = """
    SELECT a.chunk_id % 50 AS query_id, b.chunk_id,
           round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM {vectors} a JOIN {vectors} b ON b.chunk_id = a.chunk_id + 1
"""


@query("topk_per_query", f"""
    SELECT query_id, chunk_id, score, CAST(i AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM ({_NEAR}) n WHERE score >= 0.0) r
    WHERE i <= 3
""")
def topk_per_query(t: Inputs) -> DataFrame:
    following = t.vectors.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("next"))
    scored = t.vectors.join(following, "chunk_id").select(
        (F.col("chunk_id") % 50).alias("query_id"), (F.col("chunk_id") + 1).alias("chunk_id"),
        F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("score"),
    )
    return retrieval.topk_per_query(scored, 3, 0.0)


@query("topk_single", """
    SELECT c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
    FROM {vectors} c, (SELECT embedding FROM {vectors} ORDER BY chunk_id LIMIT 1) q ORDER BY score DESC, chunk_id LIMIT 5
""")
def topk_single(t: Inputs) -> DataFrame:
    vector = t.vectors.agg(F.min_by("embedding", "chunk_id").alias("e")).first()["e"]
    return retrieval.topk_single(t.vectors, vector, 5)


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


@query("rerank", f"""
    SELECT query_id, chunk_id, score, rank, rerank_score, CAST(row_number() OVER (
               PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS INT) AS rerank
    FROM (SELECT *, round(0.5::DOUBLE * score + 0.5::DOUBLE * coalesce(
                     len(list_intersect(asked, present)) / nullif(len(asked), 0)::DOUBLE, 0), 9) AS rerank_score
          FROM (SELECT f.*, {_TOKENS.format('q.text')} AS asked, {_TOKENS.format('c.text')} AS present
                FROM ({_TOP.format(where='', k=5)}) f JOIN documents q ON q.doc_id = f.query_id
                JOIN documents c ON c.doc_id = f.chunk_id) g) h
""")
def rerank(t: Inputs) -> DataFrame:
    found = retrieval.knn_join(t.vectors, _asked(t), 5, MIN_SCORE, skip_self=True)
    words = t.documents.select("doc_id", distinct_tokens(F.col("text")).alias("tokens"))
    asked = words.select(F.col("doc_id").alias("query_id"), F.col("tokens").alias("query_tokens"))
    there = words.withColumnRenamed("doc_id", "chunk_id")
    return retrieval.rerank(found.join(asked, "query_id").join(there, "chunk_id")).drop("query_tokens", "tokens")


_RULE_TEXTS = """
    SELECT id, rule_id, geometry_type, building_types, concat_ws(' ', geometry_type, array_to_string(building_types, ' '), title) AS text
    FROM {rules} WHERE is_active
"""
_ASKED_TEXTS = "SELECT DISTINCT concat_ws(' ', lower(element_type), lower(building_type)) AS text FROM {placed}"
_UNIT = "SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY KEY)) AS u FROM (SELECT KEY, place, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS w FROM (ROWS) f) g"


def _unit_sql(rows: str, key: str, corpus: str | None = None, corpus_key: str | None = None) -> str:
    return _UNIT.replace("ROWS", _weights_sql(rows, key, corpus, corpus_key)).replace("KEY", key)


@query("retrieve_and_check", f"""
    WITH RECURSIVE sims AS (
        SELECT q.text AS query_id, c.id, round(sum(q.u * c.u), 6) AS score
        FROM ({_unit_sql(_ASKED_TEXTS, 'text', _RULE_TEXTS, 'id')}) q JOIN ({_unit_sql(_RULE_TEXTS, 'id')}) c ON c.place = q.place GROUP BY q.text, c.id
    ), asked AS (
        SELECT DISTINCT concat_ws(' ', lower(element_type), lower(building_type)) AS query_id, lower(element_type) AS geometry_type,
               lower(building_type) AS building_type FROM {{placed}}
    ), hits AS (
        SELECT query_id, rule_id, max(score) AS score FROM (
            SELECT s.query_id, r.rule_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS i
            FROM sims s JOIN asked a ON a.query_id = s.query_id JOIN ({_RULE_TEXTS}) r ON r.id = s.id
            WHERE s.score >= {MIN_SCORE} AND r.geometry_type = a.geometry_type
              AND (r.building_types IS NULL OR list_contains(r.building_types, a.building_type))) t
        WHERE i <= 5 GROUP BY query_id, rule_id
    )
    SELECT e.element_id, r.rule_id, r.severity,
           concat(r.rule_type, ' ', r.value_mm, 'mm not met: ', CASE r.rule_type WHEN 'min_width' THEN e.width_mm ELSE e.height_mm END, 'mm') AS message,
           r.value_mm AS required_value, CASE r.rule_type WHEN 'min_width' THEN e.width_mm ELSE e.height_mm END AS actual_value,
           r.code_reference, h.score AS confidence_score
    FROM {{placed}} e JOIN hits h ON h.query_id = concat_ws(' ', lower(e.element_type), lower(e.building_type))
    JOIN (SELECT * FROM {{rules}} WHERE is_active) r ON r.rule_id = h.rule_id
    WHERE (r.rule_type = 'min_width' AND e.width_mm < r.value_mm) OR (r.rule_type = 'max_height' AND e.height_mm > r.value_mm)
""")
def retrieve_and_check(t: Inputs) -> DataFrame:
    active = rules.active_rules(t.rules, language=None)
    chunks = active.select(
        F.col("id").alias("chunk_id"), "rule_id", "geometry_type", "building_types",
        F.concat_ws(" ", "geometry_type", F.array_join("building_types", " "), "title").alias("text"),
    )
    embedder = retrieval.fit_embedder(chunks)
    index = retrieval.embed_chunks(chunks, embedder=embedder)
    return retrieval.retrieve_and_check(t.placed(), index, active, embedder, k=5, min_score=MIN_SCORE)
