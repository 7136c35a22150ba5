"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately; a cell is a pair of centroids.  A query ranks the centroids
of each half by distance (for the inner product: its negative) and a heap walks the pairs by summed distance until
the cells seen hold its share of the entries.  All entries of those cells are reranked by the exact
product in double precision.

Codebooks are fitted on at most ``SAMPLE`` vectors, every vector is indexed.  The share is the least that reached
``AIM`` recall against brute force for ``TRIALS`` sample queries over the sample, so it follows the data: vectors
without structure need most cells, clustered ones few.  Tables of the ``CELLS``-bounded number of cells are the only
thing sent to all tasks.

Entries are grouped into regions of about ``REGION_BYTES`` of vectors; a cell with more is dealt over several regions.
Queries go to the regions of their cells, and a region is sent once for every ``QUERIES`` queries that visit it; a task keeps the k best of a
query over all its cells there, so at most k rows for each query and region leave it.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no
part; vectors of another length than the most frequent one take no part; a repeated id is one vector (the least); with fewer
candidates than k all are returned; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.embedding_dedup import sound, unpack
from plumbline.session import cut_lineage

SAMPLE = 20_000
CELLS = 65_536
PER_CELL = 64
REGION_BYTES = 16 << 20
QUERIES = 16_384
SLICE = 128  # queries multiplied at once
AIM = 0.97
TRIALS = 128
SEED = 7


def centroids(points: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm with a fixed seed."""
    rng = np.random.default_rng(SEED)
    chosen = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(8):
        near = nearest(points, chosen)
        total = np.zeros_like(chosen)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(chosen))
        chosen = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], chosen)
    return chosen


def nearest(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (points @ to.T * -2 + (to * to).sum(axis=1)).argmin(axis=1)


class Index:
    """Codebooks of the halves and the entries of each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray, half: int):
        self.first, self.second, self.half = first, second, half
        self.counts = np.zeros(len(first) * len(second), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, :self.half], self.first) * len(self.second) + nearest(x[:, self.half:], self.second)

    def walk(self, query: np.ndarray, wanted: int, counts: np.ndarray) -> list[int]:
        """Cells by summed distance until they hold ``wanted`` entries; each pair enters the heap once."""
        far_a, far_b = -(self.first @ query[:self.half]), -(self.second @ query[self.half:])
        order_a, order_b = np.argsort(far_a, kind="stable"), np.argsort(far_b, kind="stable")
        a, b = far_a[order_a].tolist(), far_b[order_b].tolist()
        heap, seen, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(order_a[i]) * len(b) + int(order_b[j])
            out.append(cell)
            held += int(counts[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[x] + b[y], x, y))
        return out


def fit_index(sample: np.ndarray, total: int, k: int) -> tuple[Index, float]:
    """An index over the sample's halves and the share of entries a query has to see."""
    half = max(sample.shape[1] // 2, 1)
    side = int(min(max((total / PER_CELL) ** 0.5, 1), CELLS ** 0.5, len(sample)))
    index = Index(centroids(sample[:, :half], side), centroids(sample[:, half:], side), half)
    cell = index.cells(sample)
    counts = np.bincount(cell, minlength=len(index.counts))
    trial = sample[np.random.default_rng(SEED).choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    best = np.argpartition(-(trial @ sample.T), min(k, len(sample) - 1), axis=1)[:, :k + 1]
    needed = []
    for query, near in zip(trial, best, strict=True):
        walked = index.walk(query, len(sample), counts)
        place = np.full(len(counts), len(walked))
        place[walked] = np.arange(len(walked))
        seen = np.cumsum(counts[walked])
        needed.extend(seen[np.minimum(place[cell[near]], len(walked) - 1)] / len(sample))
    return index, float(np.quantile(needed, AIM)) if needed else 1.0


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest inner products found for each query among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.filter(sound() & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min("embedding").alias("embedding"))
    rows = rows.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    result = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes
    rows = rows.filter(F.size("embedding") == dim)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    index, share = fit_index(unpack(drawn["embedding"]), total, k)
    kind = rows.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.cells(unpack(batch["embedding"])) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    indexed = cut_lineage(rows.mapInArrow(place, f"vec_id long, embedding {kind}, is_query boolean, cell long"))
    for cell, count in indexed.groupBy("cell").count().collect():  # at most CELLS rows
        index.counts[cell] = count
    # Cells in turn fill regions; a large cell has regions of its own.
    most = max(REGION_BYTES // (8 * dim), 1)
    parts = np.maximum(-(-index.counts // most), 1)
    region, filled, number = np.zeros(len(parts), np.int64), 0, 0
    for cell, count in enumerate(index.counts.tolist()):
        if filled and (filled + count > most):
            number, filled = number + 1, 0
        region[cell] = number
        if parts[cell] > 1:
            number, filled = number + int(parts[cell]), 0
        else:
            filled += count
    wanted = int(np.ceil(share * total)) + k + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = np.asarray(batch["vec_id"]), np.asarray(batch["cell"])
            scrambled = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            where = region[cells] + (scrambled % parts[cells].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["embedding"], batch["cell"], pa.array(where)], names=["vec_id", "embedding", "cell", "region"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, regions, lists = [], [], []
            for i, query in enumerate(unpack(batch["embedding"]) if len(batch) else []):
                by: dict[int, list[int]] = {}
                for cell in index.walk(query, wanted, index.counts):
                    if index.counts[cell]:
                        for part in range(int(parts[cell])):
                            by.setdefault(int(region[cell]) + part, []).append(cell)
                for where, cells in by.items():
                    take.append(i)
                    regions.append(where)
                    lists.append(cells)
            picked = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(picked), batch["embedding"].take(picked), pa.array(lists, pa.list_(pa.int64())), pa.array(regions, pa.int64())],
                names=["vec_id", "embedding", "cells", "region"])

    asked = cut_lineage(indexed.filter("is_query").mapInArrow(ask, f"vec_id long, embedding {kind}, cells array<long>, region long"))
    # As many blocks as the queries that visit a region ask for: one row a region.
    loads = asked.groupBy("region").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("blocks"))
    asked = asked.join(loads, "region").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    entries = indexed.mapInArrow(deal, f"vec_id long, embedding {kind}, cell long, region long").join(loads, "region").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asked, entries = (df.drop("blocks") for df in (asked, entries))
    found = asked.groupBy("region", "block").cogroup(entries.groupBy("region", "block")).applyInArrow(_rerank(k), result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rerank(k: int) -> Callable:
    def run(asked: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and entries.num_rows:
            x, ids, cells = unpack(entries["embedding"]), np.asarray(entries["vec_id"]), np.asarray(entries["cell"])
            names, inverse = np.unique(cells, return_inverse=True)
            queries, own = unpack(asked["embedding"]), np.asarray(asked["vec_id"])
            lists = asked["cells"].to_pylist()
            for start in range(0, len(own), SLICE):
                part = slice(start, start + SLICE)
                seen = np.zeros((len(own[part]), len(names)), bool)
                for i, visited in enumerate(lists[part]):
                    at = np.searchsorted(names, visited)
                    at = at[(at < len(names))]
                    seen[i, at[np.isin(names[at], visited)]] = True
                product = np.where(seen[:, inverse], queries[part] @ x.T, -np.inf)
                product[own[part][:, None] == ids[None, :]] = -np.inf
                if len(ids) > k:
                    edge = np.partition(product, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    edge = np.full(len(product), -np.inf)
                # Near the edge all are kept: the last bits of a product depend on the shape of the multiplication.
                slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(edge), edge, 0.0)))
                q, e = np.nonzero((product >= (edge - slack)[:, None]) & np.isfinite(product))
                exact = np.einsum("ij,ij->i", queries[part][q], x[e])
                best = np.lexsort((ids[e], -exact, q))
                first = np.concatenate(([0], np.flatnonzero(np.diff(q[best])) + 1)) if len(q) else np.zeros(0, np.int64)
                rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                best = best[rank < k]
                out.append((own[part][q[best]], ids[e[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                        names=["query_id", "vec_id", "score"])

    return run


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
