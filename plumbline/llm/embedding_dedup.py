"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Vectors are compared within a label.  Each of several tables hashes a vector to the signs of a few random
projections; vectors that share a bucket in any table are compared by their exact cosine in double
precision, and a pair counts in the first table whose bucket it shares.  Bits follow the size of the largest
label, tables follow the bits, so that a pair at the threshold is missed with a chance of ``MISS`` at every
size.  A bucket beyond ``BLOCK`` vectors is compared block by block in as many tasks as it needs: tasks
return counts and local components, one row a vector, never pairs.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, and one with a null label
or id, has no links and is returned (component its own id); vectors of different length have no links; rows that
repeat a ``vec_id`` are one vector (the least label and vector count); an empty table gives an empty result; labels may be of any type and are compared as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plumbline.llm._components import connected_components
from plumbline.session import cut_lineage, scratch_path

MIN_COSINE = 0.98
MISS = 1e-6
BUCKET = 8  # vectors of a bucket, were they spread evenly
BLOCK = 1024
CELL_ROWS = 16_384
SEED = 20


def sound(embedding: str = "embedding") -> F.Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def sizing(largest: int, min_cosine: float) -> tuple[int, int]:
    """Bits of a key and number of tables."""
    bits = min(max(math.ceil(math.log2(max(largest, 1) / BUCKET)), 6), 40)
    agree = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree)))


def planes(dimension: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension, tables * bits))


def unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as a double matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _keys(tables: int, bits: int) -> Callable:
    """Adds the keys of all tables, mixed with label and length, so that equal keys mean one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["dim"])
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                # Sums in double precision over one fixed order, so that a retried task finds the same signs.
                signs = (unpack(part["embedding"]) @ planes(int(dim), tables, bits)) > 0
                powers = 1 << np.arange(bits, dtype=np.int64)
                keys = signs.reshape(len(part), tables, bits) @ powers
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["label"], part["dim"], part["embedding"],
                     pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), tables).cast(pa.list_(pa.int64()))],
                    names=["vec_id", "label", "dim", "embedding", "keys"])

    return run


def local_components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compare(min_cosine: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        ids = np.asarray(group["vec_id"], np.int64)
        buckets = np.column_stack([np.asarray(group[c], np.int64) for c in ("table", "label", "dim", "key", "low", "high")])
        block = np.asarray(group["own"], np.int64)
        order = np.lexsort(np.vstack([ids, *buckets.T[::-1]]))
        cut = np.flatnonzero(np.concatenate(([True], np.any(np.diff(buckets[order], axis=0) != 0, axis=1))))
        sizes = np.diff(np.append(cut, len(order)))
        every, found = unpack_keys(group["keys"]), []
        # Vectors of one length as one matrix; most groups have one length only.
        dims, matrix, place, norms = buckets[:, 2], {}, np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            matrix[dim] = unpack(group["embedding"] if len(at) == len(ids) else group["embedding"].take(pa.array(at)))
            place[at] = np.arange(len(at))
            norms[at] = np.sqrt((matrix[dim] * matrix[dim]).sum(axis=1))
        for start, size in zip(cut[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            rows = order[start:start + size]
            table, _, dim, _, low, high = buckets[rows[0]].tolist()
            x, norm = matrix[dim][place[rows]], norms[rows]
            near = (x @ x.T) / (norm[:, None] * norm) >= min_cosine
            a, b = np.nonzero(near)
            upper = a < b
            a, b = a[upper], b[upper]
            if low != high and len(a):  # within a block the pair (low, low) compares
                other = block[rows[a]] != block[rows[b]]
                a, b = a[other], b[other]
            if not len(a):
                continue
            own = ids[rows]
            new = ~(every[rows[a], :table] == every[rows[b], :table]).any(axis=1)
            links = np.bincount(a[new], minlength=size) + np.bincount(b[new], minlength=size)
            root = local_components(a, b, size)
            touched = np.unique(np.concatenate([a, b]))
            found.append((own[touched], links[touched], own[root[touched]]))
        parts = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [[], [], []])]
        return pa.table([pa.array(p.astype(np.int64)) for p in parts], names=["vec_id", "links", "root"])

    return run


def unpack_keys(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every ``vec_id, embedding, label``."""
    spark = vectors.sparkSession
    rows = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    if not isinstance(vectors.schema["label"].dataType, IntegralType):  # labels of another type are told apart by a number each
        labels = cut_lineage(rows.select("label").filter("label IS NOT NULL").distinct().withColumn("number", F.monotonically_increasing_id()))
        rows = rows.join(labels, "label", "left").drop("label").withColumnRenamed("number", "label")
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.size("embedding").alias("dim"), "embedding")
    largest = usable.groupBy("label", "dim").count().agg(F.max("count"), F.sum("count")).first()
    bits, tables = sizing(largest[0] or 1, min_cosine)
    kind = usable.schema["embedding"].dataType.simpleString()
    hashed = usable.mapInArrow(_keys(tables, bits), f"vec_id long, label long, dim int, embedding {kind}, keys array<long>")
    dealt = hashed.select("*", F.posexplode("keys").alias("table", "key"))
    bucket = ["table", "label", "dim", "key"]
    path = scratch_path(spark, "large-buckets")
    (hashed.select("label", "dim", F.posexplode("keys").alias("table", "key")).groupBy(*bucket).count()
     .filter(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
     .write.parquet(path))
    large = spark.read.parquet(path)
    # Vectors of a large bucket go to the task of every pair of blocks that holds their own.
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    split = dealt.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    cells = max((largest[1] or 0) * tables // CELL_ROWS + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = split.withColumn("cell", F.pmod(F.xxhash64(*bucket, "low", "high"), F.lit(cells)))
    found = cut_lineage(split.select("cell", *bucket, "low", "high", "own", "vec_id", "embedding", "keys").groupBy("cell")
                        .applyInArrow(_compare(min_cosine), "vec_id long, links long, root long"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    components = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(links, "vec_id", "left")
            .join(components.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# DuckDB: every pair of a label.
OP4_SQL = """
    WITH RECURSIVE sound AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
          AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
    reach(id, root) AS (
        SELECT vec_id, vec_id FROM sound UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id AND r.root < l.b),
    least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
    SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
           coalesce(min(least.root), e.vec_id) AS component_id, coalesce(min(least.root), e.vec_id) = e.vec_id AS kept
    FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN least ON least.id = e.vec_id GROUP BY e.vec_id
"""
