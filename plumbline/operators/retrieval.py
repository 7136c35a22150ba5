"""Rule-text chunks, embeddings and vector search.

Exact search never forms the pairs of queries and chunks as rows: blocks of both meet in tasks that multiply
matrices and keep k results per query (``block_search``).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators import rules as rule_ops
from plumbline.session import cut_lineage

# The documented retrieval settings.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
TOP_K = 5
MIN_SCORE = 0.7
DIMENSION = 1536

# Scores are rounded so that ranks do not depend on the summation order of a task.
SCORE_DIGITS = 6
# Rows of one side of a block of ``block_search``.
BLOCK_ROWS = 16384
# Pairs of a block whose scores are held at a time.
TILE_PAIRS = 1 << 20
# ``fit_probing``: the share of exact results that a sample of queries must find.
RECALL = 0.92
SAMPLE_QUERIES = 200


# ---------------------------------------------------------------- documents and chunks

def ingest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document texts -> one row per page; pages are separated by form feeds."""
    pages = F.posexplode(F.split(text, "\f")).alias("_p", "text")
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, pages).withColumn("page_number", F.col("_p") + 1).drop("_p")


def chunk(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
          text: str = "text", unit: str = "character") -> DataFrame:
    """Overlapping chunks of whole texts: ``chunk_index`` and the chunk in ``text``.

    The unit is characters, or whitespace tokens.  Narrow: explodes within the row.
    """
    stride = size - overlap
    keep = [c for c in df.columns if c != text]
    if unit == "character":
        length, source = F.length(text), F.col(text)
    elif unit == "token":
        source = F.filter(F.split(text, r"\s+"), lambda t: t != "")
        length = F.size(source)
    else:
        raise ValueError(f"unknown chunk unit: {unit}")
    last = F.greatest(F.ceil((length - overlap) / F.lit(stride)).cast("int"), F.lit(1)) - 1
    rows = df.select(*keep, source.alias("_s"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * stride + 1
    if unit == "character":
        piece = F.substr("_s", start, F.lit(size))
    else:
        piece = F.array_join(F.slice("_s", start, F.lit(size)), " ")
    return rows.withColumn("text", piece).drop("_s")


# ---------------------------------------------------------------- embeddings

# Fixed value: what parts tokens, in the regular expressions of this engine and of others.
BETWEEN_TOKENS = r"[^\p{L}\p{N}]+"


def token_places(text: str | Column, dim: int) -> Column:
    """Ascending places of a text's tokens, one for each token: the first 12 hex digits of its md5, modulo ``dim``."""
    tokens = F.filter(F.split(F.lower(text), BETWEEN_TOKENS), lambda t: t != "")
    return F.sort_array(F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 12), 16, 10).cast("long"), F.lit(dim)).cast("int")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class HashedTfIdf:
    """Term counts in ``dim`` hashed places, weighted by inverse document frequency, unit length; built-in functions only.

    Fitting counts the documents of each place in one job; at most ``dim`` numbers come back.
    """

    def __init__(self, idf: np.ndarray):
        self.idf = np.asarray(idf, np.float64)

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", dim: int = DIMENSION, places: Column | None = None) -> HashedTfIdf:
        """``places``: the texts' places, null for a null text, if they are known."""
        found = token_places(text, dim) if places is None else places
        places = df.select(F.array_distinct(found).alias("places")).filter("places IS NOT NULL")
        # the place -1 counts the texts
        held = places.select(F.explode(F.concat(F.array(F.lit(-1)), "places")).alias("place")).groupBy("place").count().collect()
        counts = {r.place: r["count"] for r in held}
        idf = np.zeros(dim)
        for place, n in counts.items():
            if place >= 0:
                idf[place] = math.log((counts[-1] + 1) / (n + 1))
        return cls(idf)

    def _weights(self, places: Column) -> Column:
        """Equal places stand side by side, so a look at the one before finds where each begins, and the next beginning how often it occurs."""
        idf = F.split(F.lit(",".join(map(repr, self.idf.tolist()))), ",").cast("array<double>")

        def weighed(p: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: (i < F.size(p)) & ((i == 0) | (F.get(p, i) != F.get(p, i - 1))))
            raw = _let(begins, lambda first: F.transform(first, lambda i, at: F.struct(
                F.get(p, i).alias("place"), ((F.coalesce(F.get(first, at + 1), F.size(p)) - i) * F.get(idf, F.get(p, i))).alias("weight"))))
            return F.filter(raw, lambda r: r.weight != 0)

        def unit(raw: Column) -> Column:
            norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda total, r: total + r.weight * r.weight))
            return _let(norm, lambda n: F.transform(raw, lambda r: F.struct(r.place.alias("place"), (r.weight / n).alias("weight"))))

        return _let(F.coalesce(places, F.array().cast("array<int>")), lambda p: _let(weighed(p), unit))

    def weights(self, df: DataFrame, text: str = "text", places: Column | None = None) -> DataFrame:
        """Adds ``weights``: the places that are not zero, ascending, as an array of ``place, weight``; ``places``: the text's, if they are known."""
        return df.withColumn("weights", self._weights(token_places(text, len(self.idf)) if places is None else places))

    def transform(self, df: DataFrame, text: str = "text", places: Column | None = None) -> DataFrame:
        """Adds ``embedding``, the dense vector that search wants: weights with the zeros between them."""
        def zeros(n: Column) -> Column:
            return F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))

        def dense(w: Column) -> Column:
            gap = lambda r, at: r.place - F.coalesce(F.get(w, at - 1).place + 1, F.lit(0))
            filled = F.flatten(F.transform(w, lambda r, at: F.concat(zeros(gap(r, at)), F.array(r.weight.cast("float")))))
            return F.concat(filled, zeros(F.lit(len(self.idf) - 1) - F.coalesce(F.get(w, F.size(w) - 1).place, F.lit(-1))))

        return df.withColumn("embedding", _let(self._weights(token_places(text, len(self.idf)) if places is None else places), dense))


fit_embedder = HashedTfIdf.fit


def embed_chunks(df: DataFrame, text: str = "text", dim: int = DIMENSION,
                 embedder: HashedTfIdf | Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``embedding``.  ``embedder`` is a fitted model, or a Column function such as an
    Arrow ``pandas_udf`` around another model; without one the default is fitted to ``df``."""
    if embedder is None:
        stored = cut_lineage(df.withColumn("_places", token_places(text, dim)))  # texts are read once for both
        found = fit_embedder(stored, text, dim, F.col("_places")).transform(stored, text, F.col("_places"))
        return found.drop("_places")
    if isinstance(embedder, HashedTfIdf):
        return embedder.transform(df, text)
    return df.withColumn("embedding", embedder(F.col(text)))


def upsert_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows plus the ``existing`` ones whose chunk id is not replaced."""
    return new.unionByName(existing.join(new.select("chunk_id"), "chunk_id", "left_anti"))


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("language").parquet(path)


# ---------------------------------------------------------------- ranking

def topk_per_query(scored: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Best ``k`` rows per query with ``rank``; ties by chunk id.

    The rank filter is pushed below the shuffle, which then carries k rows per query and task.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    kept = scored.filter(F.col("score") >= min_score)
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rerank(found: DataFrame, query_tokens: str = "query_tokens", tokens: str = "tokens") -> DataFrame:
    """Second order of found chunks: half vector score, half share of query tokens present.

    Both sides bring their distinct tokens (``distinct_tokens``), made once a document and not once a pair.
    """
    asked = F.col(query_tokens)
    shared = F.size(F.array_intersect(asked, F.col(tokens)))
    overlap = F.coalesce(shared / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))
    mixed = F.round(0.5 * F.col("score") + 0.5 * overlap, SCORE_DIGITS + 3)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
    return found.withColumn("rerank_score", mixed).withColumn("rerank", F.row_number().over(order))


# ---------------------------------------------------------------- search kernels (run in tasks)

def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows in double precision; zero vectors become NaN and match nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    rows = values.reshape(len(column), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _cut(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def _tiles(queries: int, chunks: int) -> Iterator[slice]:
    """Parts of a block's queries, so that a part meets at most ``TILE_PAIRS`` chunks, and one query at least."""
    step = min(256, max(1, TILE_PAIRS // max(chunks, 1)))
    return (slice(at, at + step) for at in range(0, queries, step))


def _best(q_ids: pd.Series, q: np.ndarray, chunks: pa.Table, k: int, min_score: float, skip_self: bool) -> pd.DataFrame:
    """Top k chunks of a block per query, ties by chunk id.  ``q`` has unit rows."""
    c_ids, c = chunks["chunk_id"].to_pandas(), _matrix(chunks["embedding"])
    found = []
    for tile in _tiles(len(q), len(c)):
        with np.errstate(invalid="ignore"):
            scores = np.round(q[tile] @ c.T, SCORE_DIGITS)
        scores[np.isnan(scores)] = -np.inf
        if skip_self:
            scores[q_ids.to_numpy()[tile, None] == c_ids.to_numpy()[None, :]] = -np.inf
        least = np.full(len(scores), float(min_score))
        if scores.shape[1] > k:
            # all ties of the k-th score stay until ids decide
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        found.append(_cut(pd.DataFrame({
            "query_id": q_ids.iloc[tile.start + row].to_numpy(), "chunk_id": c_ids.iloc[col].to_numpy(),
            "score": scores[row, col],
        }), k))
    return pd.concat(found, ignore_index=True)


def _result_schema(index: DataFrame, query_id: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", query_id),
        T.StructField("chunk_id", index.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def block_search(index: DataFrame, queries: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE,
                 skip_self: bool = False, block_rows: int = BLOCK_ROWS, bucket: bool = True,
                 kernel: Callable[..., pd.DataFrame] = _best) -> DataFrame:
    """Partial results of queries against chunks, of the same ``bucket`` if rows have one.

    Both sides are dealt into blocks of about ``block_rows``; each pair of blocks meets once, in a task of
    its own, and returns k rows per query.  So a chunk travels once per block of queries and the other way round: comparing all with
    all is |queries| x |chunks| work by nature, and this is its bounded form.  Where that is too much, use ``approx_search``.
    """
    schema = _result_schema(index, queries.schema["query_id"].dataType)
    arrow = _arrow_schema(schema)
    key = ["bucket", "_i", "_q"] if bucket else ["_i", "_q"]

    def count(df: DataFrame, name: str) -> DataFrame:
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)), F.lit(1)).cast("int").alias(name)
        return (df.groupBy("bucket") if bucket else df.groupBy()).agg(blocks)

    if bucket:
        sizes = count(index, "_ni").join(count(queries, "_nq"), "bucket")
    else:
        n_index, n_queries = count(index, "n").scalar(), count(queries, "n").scalar()

    def dealt(df: DataFrame, row_id: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        df = df.join(sizes, "bucket") if bucket else df.withColumns({"_ni": n_index, "_nq": n_queries})
        return df.withColumns({
            own: F.pmod(F.xxhash64(row_id), F.col(own_n)).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)),
        }).drop("_ni", "_nq")

    left = dealt(index, "chunk_id", "_i", "_ni", "_q", "_nq")
    right = dealt(queries, "query_id", "_q", "_nq", "_i", "_ni")

    def run(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        if not chunks.num_rows or not asked.num_rows:
            return arrow.empty_table()
        best = kernel(asked["query_id"].to_pandas(), _matrix(asked["embedding"]), chunks, k, min_score, skip_self)
        return pa.Table.from_pandas(best, schema=arrow, preserve_index=False)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


# ---------------------------------------------------------------- search

def _prepared(df: DataFrame, row_id: str, match_on: list[str] | None) -> DataFrame:
    """``<row_id>, embedding`` and, to match columns, ``bucket``; a null in a matched column matches nothing."""
    columns = [row_id, "embedding"]
    if match_on:
        df = df.dropna(subset=match_on)
        columns.append(F.to_json(F.array(*[F.col(c).cast("string") for c in match_on])).alias("bucket"))
    return df.filter(F.col("embedding").isNotNull()).select(*columns)


def vector_search(index: DataFrame, queries: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE,
                  match_on: list[str] | None = None, skip_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact search: ``query_id, chunk_id, score, rank`` of the ``k`` nearest chunks per query; one plan for every size.

    ``match_on`` columns must be equal on both sides: only rows that agree meet.  Filters on
    constants belong on ``index`` itself, where they reach the scan.
    """
    found = block_search(_prepared(index, "chunk_id", match_on), _prepared(queries, "query_id", match_on), k, min_score, skip_self,
                         block_rows, bucket=bool(match_on))
    return topk_per_query(found, k, min_score)


knn_join = vector_search


def topk_single(index: DataFrame, query: list[float], k: int = TOP_K) -> DataFrame:
    """Best ``k`` chunks for one vector, in total order: the index stays in place, k rows per task, then one merge of those."""
    schema = _result_schema(index, T.StringType())
    arrow = _arrow_schema(schema)
    asked = _matrix(pa.array([[float(x) for x in query]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            if batch.num_rows:
                best = _best(pd.Series(["q"]), asked, pa.Table.from_batches([batch]), k, -1.0, False)
                kept = best if kept is None else _cut(pd.concat([kept, best], ignore_index=True), k)
        if kept is not None and len(kept):
            yield from pa.Table.from_pandas(kept, schema=arrow, preserve_index=False).to_batches()

    found = _prepared(index, "chunk_id", None).mapInArrow(run, schema)
    return found.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(k)


def filtered_search(index: DataFrame, queries: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE,
                    match_on: tuple[str, ...] = ("geometry_type", "language"),
                    building_types: str | None = "building_types", **options) -> DataFrame:
    """Search among chunks whose metadata fit the query.

    ``match_on`` must be equal.  A chunk with a list of building types fits queries of those
    types, one without fits all: chunks repeat per type and queries ask under their own type
    and under "all", so building type is an equality like the others and pairs stay unique.
    """
    match = list(match_on)
    if building_types and building_types in index.columns:
        every = F.lit("*")
        scope = F.when(F.col(building_types).isNull(), F.array(every)).otherwise(F.array_distinct(building_types))
        index = index.withColumn("_scope", F.explode(scope))
        own = F.array_distinct(F.array(every, F.coalesce(F.lower("building_type"), every)))
        queries = queries.withColumn("_scope", F.explode(own))
        match.append("_scope")
    return vector_search(index, queries, k, min_score, match_on=match, **options)


@functools.lru_cache(maxsize=4)
def _planes(count: int, dim: int, seed: int = 42) -> np.ndarray:
    """Planes of +1 and -1 as columns, from a hash that other engines have too; made once a worker process."""
    names = (f"{seed}:{b}:{d}" for d in range(dim) for b in range(count))
    return np.array([1.0 if hashlib.md5(name.encode()).hexdigest()[0] < "8" else -1.0 for name in names]).reshape(dim, count)


def probe_sequence(margins: np.ndarray, probes: int) -> list[int]:
    """The ``probes`` codes nearest to a query, nearest first.

    ``margins`` are the query's projections on the planes of a code.  To leave the query's own side of a plane costs the distance to it, so codes come
    in the order of the sum of what they cross: a heap holds sets of planes, in the order of their distances, and each set taken is followed
    by the one with its farthest plane moved on and the one with the next plane added.
    """
    order = np.argsort(np.abs(margins), kind="stable")
    cost = np.abs(margins)[order].tolist()
    flip = [1 << int(b) for b in order]
    code = int(sum(1 << i for i, m in enumerate(margins) if m >= 0))
    found = [code]
    heap = [(cost[0], 0, flip[0])] if cost else []
    while heap and len(found) < probes:
        total, at, flips = heapq.heappop(heap)
        found.append(code ^ flips)
        if at + 1 < len(cost):
            heapq.heappush(heap, (total + cost[at + 1], at + 1, flips | flip[at + 1]))
            heapq.heappush(heap, (total - cost[at] + cost[at + 1], at + 1, flips ^ flip[at] | flip[at + 1]))
    return found


@dataclass(frozen=True)
class Probing:
    """How far ``approx_search`` looks: the share of cells a query visits, and the share of a visited block's chunks that it scores."""

    cells: float = 1.0
    scored: float = 0.1
    planes: int = 256


# From the narrowest to the exact search.
PROBINGS = [Probing(cells, scored) for cells, scored in ((0.02, 0.1), (0.1, 0.1), (0.3, 0.1), (1.0, 0.1), (1.0, 0.2), (1.0, 0.5), (1.0, 1.0))]


def _cells(df: DataFrame, bits: Column, share: float | None) -> DataFrame:
    """Adds ``_cell``: a chunk's own code, or with ``share`` each of the codes that a query visits."""
    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series, widths: pd.Series) -> pd.Series:
        width = int(widths.iloc[0]) if len(widths) else 0
        if not width or share is not None and math.ceil(share * 2**width) == 2**width:  # all cells, in no order
            return pd.Series([list(range(2**width))] * len(vectors))
        rows = np.stack(vectors.to_numpy()).astype("float64")
        margins = rows @ _planes(width, rows.shape[1])
        if share is None:
            return pd.Series([[int(c)] for c in (margins >= 0) @ (1 << np.arange(width, dtype=np.int64))])
        return pd.Series([probe_sequence(m, math.ceil(share * 2**width)) for m in margins])

    return df.withColumn("_bits", bits).select(*df.columns, F.explode(codes("embedding", "_bits")).alias("_cell"))


def _nearest(margins: np.ndarray, sides: np.ndarray, out: np.ndarray, take: int) -> np.ndarray:
    """Mask of the ``take`` codes nearest to each query, ties at the cut included; ``out`` tells pairs that take no part.

    The sum of a query's margins, each with the sign of the chunk's side, is the higher, the less lies between the query and the code.  It is made in single precision;
    what lies so near to the cut that this could decide is summed again in double precision.
    """
    near = margins.astype("float32") @ sides.T
    near[out] = -np.inf
    n = near.shape[1]
    if take >= n:
        return near > -np.inf
    cut = np.partition(near, n - take, axis=1)[:, n - take, None]
    # bound of the rounding errors of a sum in single precision, and of the rounded digits
    doubt = 2 * ((margins.shape[1] + 2) * 2.0**-24 * np.abs(margins).sum(axis=1) + 10.0**-SCORE_DIGITS)[:, None].astype("float32")
    mask = near > cut + doubt
    row, col = np.divmod(np.flatnonzero((near >= cut - doubt) & ~mask & (near > -np.inf)), n)
    exact = np.round(np.einsum("ij,ij->i", margins[row], sides[col].astype("float64")), SCORE_DIGITS)
    missing = take - mask.sum(axis=1)  # of the doubtful ones, with ties
    order = np.lexsort((-exact, row))
    place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    least = np.full(len(margins), -np.inf)
    at_cut = place == missing[row[order]] - 1
    least[row[order][at_cut]] = exact[order][at_cut]
    mask[row, col] = exact >= least[row]
    return mask


def _probed(q_ids: pd.Series, q: np.ndarray, chunks: pa.Table, k: int, min_score: float, skip_self: bool, probing: Probing) -> pd.DataFrame:
    """``_best`` among the chunks of a block whose codes lie nearest to the query; ties at the cut stay."""
    c_ids, c = chunks["chunk_id"].to_pandas(), _matrix(chunks["embedding"])
    dim, n = c.shape[1], len(c)
    planes = _planes(probing.planes, dim)
    sides = np.where(c @ planes >= 0, np.float32(1.0), np.float32(-1.0))
    take = min(n, math.ceil(probing.scored * n))
    broken, nothing = np.isnan(c).any(axis=1), np.isnan(q).any(axis=1)
    c, q = np.where(broken[:, None], 0.0, c), np.where(nothing[:, None], 0.0, q)
    found = []
    for tile in _tiles(len(q), n):
        part = q[tile]
        out = nothing[tile, None] | broken[None, :]
        if skip_self:
            out = out | (q_ids.to_numpy()[tile, None] == c_ids.to_numpy()[None, :])
        scores = part @ c.T
        mask = _nearest(part @ planes, sides, out, take)
        row, col = np.divmod(np.flatnonzero(mask & (scores >= min_score - 10.0**-SCORE_DIGITS)), n)
        scores = np.round(scores[row, col], SCORE_DIGITS)
        # k for each query, with the ties that ids decide
        order = np.lexsort((-scores, row))
        begin = np.searchsorted(row[order], np.arange(len(part) + 1))
        last = np.minimum(begin[:-1] + k, begin[1:]) - 1
        least = np.where(last >= begin[:-1], scores[order][np.maximum(last, 0)] if len(order) else np.inf, np.inf)
        good = (scores >= min_score) & (scores >= least[row])
        found.append(_cut(pd.DataFrame({
            "query_id": q_ids.iloc[tile.start + row[good]].to_numpy(), "chunk_id": c_ids.iloc[col[good]].to_numpy(), "score": scores[good],
        }), k))
    return pd.concat(found, ignore_index=True)


def approx_search(index: DataFrame, queries: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE,
                  probing: Probing | None = None, match_on: list[str] | None = None, skip_self: bool = False,
                  cell_rows: int = BLOCK_ROWS) -> DataFrame:
    """Search by query-directed probing, scored exactly; one plan at every size.

    Chunks lie in cells, by the sides of as many planes as leave about ``cell_rows`` in a cell.  A query visits cells in the order of their distance
    (``probe_sequence``), and inside a cell scores the chunks whose longer codes lie nearest to it, also in the order of what is crossed.
    ``probing`` says how far either goes; ``fit_probing`` measures what a wanted recall asks for.  A cell with many chunks, such as
    copies, is dealt into blocks; each block returns k rows a query, so no pair becomes a row.
    """
    probing = probing or Probing()
    index, queries = (_prepared(df, name, match_on) for df, name in ((index, "chunk_id"), (queries, "query_id")))
    rows = index.agg(F.count(F.lit(1)).alias("n")).scalar()
    bits = F.greatest(F.ceil(F.log2(F.greatest(rows, F.lit(1)) / F.lit(cell_rows))), F.lit(0)).cast("int")
    own = [F.col("bucket")] if match_on else []

    def celled(df: DataFrame, name: str, share: float | None) -> DataFrame:
        cells = _cells(df, bits, share)
        return cells.select(name, "embedding", F.concat_ws(":", F.col("_cell").cast("string"), *own).alias("bucket"))

    kernel = functools.partial(_probed, probing=probing)
    found = block_search(celled(index, "chunk_id", None), celled(queries, "query_id", probing.cells), k, min_score, skip_self, kernel=kernel)
    return topk_per_query(found, k, min_score)


def fit_probing(index: DataFrame, queries: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE, recall: float = RECALL,
                match_on: list[str] | None = None, skip_self: bool = False, cell_rows: int = BLOCK_ROWS) -> Probing:
    """The narrowest of ``PROBINGS`` that finds ``recall`` of the exact results of ``SAMPLE_QUERIES`` queries (in the order of a hash)."""
    sample = cut_lineage(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES))
    pair = ["query_id", "chunk_id"]
    exact = cut_lineage(vector_search(index, sample, k, min_score, match_on, skip_self).select(*pair))
    wanted = recall * exact.count()
    for probing in PROBINGS[:-1]:
        found = approx_search(index, sample, k, min_score, probing, match_on, skip_self, cell_rows)
        if found.join(exact, pair, "left_semi").count() >= wanted:
            return probing
    return PROBINGS[-1]


# ---------------------------------------------------------------- retrieval and check

def retrieve_and_check(elements: DataFrame, chunks: DataFrame, rules: DataFrame,
                       embedder: HashedTfIdf | Callable[[Column], Column], k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Violations of elements against the rules retrieved for them; confidence is the score.

    Elements with the same query text share one search, so the number of queries is the
    number of distinct (type, building type) texts, not of elements.  These are stored once embedded: no filter can carry the embedding
    below the aggregate, to where it would be made for every element, and a model is called once a text.
    """
    asked = elements.withColumn("query_id", F.concat_ws(" ", F.lower("element_type"), F.lower("building_type")))
    queries = asked.groupBy("query_id").agg(
        F.any_value(F.lower("element_type")).alias("geometry_type"),
        F.any_value(F.lower("building_type")).alias("building_type"),
    ).withColumn("text", F.col("query_id"))
    queries = cut_lineage(embed_chunks(cut_lineage(queries), embedder=embedder))
    found = filtered_search(chunks, queries, k, min_score, match_on=("geometry_type",))
    hits = found.join(chunks.select("chunk_id", "rule_id"), "chunk_id").groupBy("query_id", "rule_id").agg(
        F.max("score").alias("score")
    )
    return rule_ops.evaluate_retrieved(asked, hits.join(rules, "rule_id"))
