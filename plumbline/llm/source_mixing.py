"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  A small flow network routes
token capacity from patterns to source quotas: a pattern can give its tokens once for nothing, a second and a third time
at rising cost (convex, so an earlier repetition is always used up first), and every token goes to one of its
sources.  The cheapest full flow says how many tokens each pattern gives; documents are then selected in a seeded
order until the pattern's amount is met, whole documents only, so a pattern misses its amount by half a document at most.

A source that no document shares with another is a network of one edge: its flow is the smaller of quota and capacity, taken as a
column, so any number of such sources is no matter.  Only patterns that overlap, and those they compete with, are routed on the
driver: at most ``MAX_PATTERNS`` of them, whatever the number of documents (more raise an error).  The seeded order is cut by hash
prefix: sums per prefix name the one prefix where a pattern's amount ends, and only that prefix's rows are sorted.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share the words of all sources; a target
above ``MAX_REPEATS`` times its source's size stops there and the excess is shared out by weight among the others.

Defined cases: a null text has no words and is taken zero words; a null or empty set of sources is the null source; repeated
rows are documents of their own; a null ``doc_id`` takes part; an empty table gives an empty result; other columns, whatever
their names, pass unread (``size, pattern, repeats, taken`` are replaced).
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
REPEAT_COSTS = (0, 1, 3)
MAX_PATTERNS = 100_000
BROADCAST_ROWS = 100_000  # rows of a table sent to every task at most
SEED = "mix-1"
PREFIX_ROWS = 10_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``repeats`` times its size; the plain form of ``goals``, for a list of sources."""
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    left, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    for place, i in enumerate(order):
        if weights[i] * (left / weight) > repeats * sizes[i]:
            out[i] = float(repeats * sizes[i])
            left, weight = left - repeats * sizes[i], weight - weights[i]
            continue
        for j in order[place:]:
            out[j] = weights[j] * (left / weight)
        break
    return out


def route(tokens: list[int], members: list[list[int]], quotas: list[int]) -> list[int]:
    """Tokens each pattern gives: the cheapest of the largest flows, by successive shortest paths with potentials.

    Nodes: start, patterns, sources, end.  An augmentation saturates an edge, so their number follows the network.
    """
    n, m = len(tokens), len(quotas)
    end = n + m + 1
    edges: list[list[int]] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def join(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for p in range(n):
        for cost in REPEAT_COSTS:
            join(0, 1 + p, tokens[p], cost)
        for s in members[p]:
            join(1 + p, 1 + n + s, sum(quotas), 0)
    for s in range(m):
        join(1 + n + s, end, quotas[s], 0)
    potential = [0] * (end + 1)
    while True:
        far, came = [math.inf] * (end + 1), [-1] * (end + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, cost = edges[e]
                step = d + cost + potential[a] - potential[b]
                if room and step < far[b]:
                    far[b], came[b] = step, e
                    heapq.heappush(heap, (step, b))
        if far[end] == math.inf:
            return [sum(edges[e ^ 1][1] for e in out[1 + p] if e % 2 == 0) for p in range(n)]
        potential = [p + (d if d < math.inf else 0) for p, d in zip(potential, far, strict=True)]
        path, b = [], end
        while b:
            path.append(came[b])
            b = edges[came[b] ^ 1][0]
        flow = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= flow
            edges[e ^ 1][1] += flow


@dataclass
class Mix:
    """What mixing gives: ``rows`` with size, pattern and taken, and ``sources`` with name, source_size and target."""

    rows: DataFrame
    sources: DataFrame


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Sent to every task while small, so that no hot key is dealt to one; else joined by shuffles with adaptive splitting."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def goals(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to ``name, source_size, shared``; sources are numbered by a range sort, without one task for all.

    The level of words a unit of weight rises as sources reach their limit and leave their excess, until no further one does.
    """
    spark = sources.sparkSession
    placed = cut_lineage(sources.sort(F.col("name").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    offsets, before = [], 0
    for part, rows in sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect()):  # a row a partition
        offsets.append((part, before))
        before += rows
    starts = spark.createDataFrame(offsets, "part int, start long")
    order = Window.partitionBy("part").orderBy(F.col("name").asc_nulls_last())
    number = F.col("start") + F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (number % len(WEIGHTS) + 1).cast("int"))
    weighed = cut_lineage(placed.join(F.broadcast(starts), "part").withColumn("weight", weight).drop("part", "start"))
    limit = F.col("source_size") * MAX_REPEATS
    words, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weight_left, full = words or 0, weights or 0, 0
    while True:
        level = left / weight_left if weight_left else 0.0
        over = F.col("weight") * F.lit(level) > limit
        n, taken, gone = weighed.filter(over).agg(F.count("*"), F.sum(limit), F.sum("weight")).first()
        if n == full:
            return weighed.withColumn("target", F.when(over, limit.cast("double")).otherwise(F.col("weight") * F.lit(level))).drop("weight")
        left, weight_left, full = words - taken, weights - gone, n


def routed(groups: DataFrame, quotas: DataFrame) -> DataFrame:
    """``pattern, given`` of the patterns that overlap or share a source with one that does, by the flow network."""
    spark = groups.sparkSession
    shared = quotas.filter("shared").withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    pairs = groups.select("pattern", "tokens", F.posexplode("members").alias("at", "source")).join(shared, F.col("source").eqNullSafe(F.col("name")))
    found = (pairs.groupBy("pattern", "tokens").agg(F.sort_array(F.collect_list(F.struct("at", "name", "quota"))).alias("members"))
             .orderBy("pattern").limit(MAX_PATTERNS + 1).collect())
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} overlapping sets of sources")
    quota = {m.name: m.quota for r in found for m in r.members}
    number = {s: i for i, s in enumerate(sorted(quota, key=lambda s: (s is None, s or "")))}
    given = route([r.tokens for r in found], [[number[m.name] for m in r.members] for r in found], [quota[s] for s in number])
    return spark.createDataFrame([(r.pattern, g) for r, g in zip(found, given, strict=True)], "pattern string, given long")


def mix_sources(docs: DataFrame, sources: Column, keep: list[str] | None = None) -> Mix:
    """Adds ``size``, ``pattern`` (sources as JSON), ``repeats`` and ``taken`` to the columns ``keep`` (default: all).

    ``sources`` is an array of source names.
    """
    some = F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    names = keep if keep is not None else [c for c in docs.columns if c not in ("size", "pattern", "repeats", "taken")]
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = cut_lineage(docs.select(F.struct(*names).alias("row"), word_count().alias("size"), F.to_json(some, {"ignoreNullFields": "false"}).alias("pattern"),
                                    order.alias("order"), F.col("doc_id").alias("id")))
    groups = cut_lineage(sized.groupBy("pattern").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
                         .withColumn("members", F.from_json("pattern", "array<string>")))
    number, most = groups.agg(F.count("*"), F.max("n")).first()
    table = goals(groups.select(F.explode("members").alias("name"), "tokens", (F.size("members") > 1).alias("shared"))
                  .groupBy("name").agg(F.sum("tokens").alias("source_size"), F.max("shared").alias("shared")))
    table = cut_lineage(table)
    known, overlap = table.agg(F.count("*"), F.max("shared")).first()
    alone = table.filter("NOT shared")
    given = (groups.filter(F.size("members") == 1).join(alone, F.col("members")[0].eqNullSafe(F.col("name")))
             .select("pattern", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("tokens") * MAX_REPEATS).alias("given")))
    if overlap:
        given = given.unionByName(routed(groups, table))
    # Whole rounds for every document, and a rest that is selected.
    amounts = cut_lineage(given.join(groups.select("pattern", "tokens"), "pattern").select(
        "pattern", F.expr("coalesce(given div nullif(tokens, 0), 0)").alias("rounds"), F.expr("coalesce(given % nullif(tokens, 0), 0)").alias("rest")))
    digits = max(1, min(6, math.ceil(math.log(max((most or 0) / PREFIX_ROWS, 1), 16))))
    prefix = F.substring("order", 1, digits)
    sums = sized.groupBy("pattern", prefix.alias("prefix")).agg(F.sum("size").alias("size"))
    running = Window.partitionBy("pattern").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    ends = (sums.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0))).join(amounts, "pattern")
            .filter("before <= rest AND before + size > rest").select("pattern", F.col("prefix").alias("last"), "before"))
    chosen = sized.join(_few(amounts.join(ends, "pattern", "left"), number), "pattern").withColumn("prefix", prefix)
    inner = Window.partitionBy("pattern").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2
    cut = chosen.filter("prefix = last").withColumn("extra", F.when(middle <= F.col("rest"), 1).otherwise(0))
    whole = F.when(F.col("last").isNotNull() & (F.col("prefix") < F.col("last")) & (F.col("rest") > 0), 1).otherwise(0)
    both = cut.unionByName(chosen.filter("last IS NULL OR prefix <> last").withColumn("extra", whole))
    result = both.withColumn("repeats", (F.col("rounds") + F.col("extra")).cast("int")).withColumn("taken", F.col("size") * F.col("repeats"))
    return Mix(result.select("row.*", "size", "pattern", "repeats", "taken"), _few(table.drop("shared"), known))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_sources(docs, F.array("source"), keep=["doc_id", "source"])
    return mixed.rows.join(mixed.sources, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h
        FROM documents),
    sources AS (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source),
    weighed AS (
        SELECT source, n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
               row_number() OVER (ORDER BY source NULLS LAST) AS i
        FROM sources),
    ranked AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, i) AS place FROM weighed),
    levels AS (
        SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                  / (sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
        FROM ranked),
    stop AS (SELECT min(place) AS place, min_by(level, place) AS level FROM levels WHERE w * level <= 3 * n),
    goals AS (
        SELECT l.source, l.n, CASE WHEN l.place < s.place THEN (3 * l.n)::DOUBLE ELSE l.w * s.level END AS target
        FROM levels l, stop s),
    amounts AS (
        SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // n END AS rounds,
               CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) % n END AS rest
        FROM goals),
    placed AS (
        SELECT d.*, a.n, a.target, a.rounds, a.rest,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
        FROM sized d JOIN amounts a ON a.source IS NOT DISTINCT FROM d.source)
    SELECT doc_id, size, n AS source_size, target,
           CAST(size * (rounds + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM placed
"""
