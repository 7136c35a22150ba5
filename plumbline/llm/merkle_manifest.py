"""Merkle manifest of a dataset: a leaf for every document, a tree for every source, a tree over the sources' roots.

A digest ``H`` is the lowercase hexadecimal SHA-256 of its inputs' text, one after the other.  Nodes form runs of ``FANOUT``
in their order; the last run may be shorter, even of one, and each run becomes its ``H`` as long as several nodes remain.

The upper levels are found by *butterfly exchange*.  Leaves are dealt into partitions of ``FANOUT ** BLOCK_LEVELS`` that lie one after
the other, and each partition hashes its own leaves.  Then, round by round, the partitions below one parent swap the roots of their
subtrees: partition number j below a child meets the partitions number j below the other children, so it gets every
sibling of its node and hashes the parent itself, as all others below that parent do.  After the last round each partition
holds the siblings of all its ancestors, and no second pass from the root down is needed.  Where children cover different
numbers of partitions (the last child of a tree, small sources beside large ones), the partitions of a small child answer for several numbers.
A round is one shuffle of at most ``FANOUT`` digests a partition; a group never holds more than ``FANOUT`` rows.

Positions come from a range sort and counts per sorted partition, so no source passes through one task.

Defined cases: a null column counts as ``-``, an empty text as ``0:``; a null ``source`` is a source of its own, which comes first; null
``doc_id`` come first in their source; rows of one ``doc_id`` follow the order of their leaves, repeated rows are leaves of their own (in either order); texts of any
length are hashed whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm._crc_sql import CRC_TABLE, crc32_sql
from plumbline.session import cut_lineage

FANOUT = 16
BLOCK_LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_SHARE = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes, so that no two rows read alike."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return digest(*told)


def runs_of(nodes: Column, fanout: int) -> Column:
    """The next level: a digest for each run of an array of nodes."""
    last = F.floor((F.size(nodes) - 1) / fanout)
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(joined(F.slice(nodes, (i * fanout + 1).cast("int"), F.lit(fanout)))))


def ranked(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Adds ``label``, the place from 0 of each row in its group, and ``<label>_of``, the group's rows.

    ``df`` is sorted by range; what is then summed has a row for each sorted partition and group in it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first(c) for c in (*group, *order)]
    row = F.monotonically_increasing_id()
    placed = cut_lineage(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns(
        {"_part": F.shiftright(row, 33), "_row": row.bitwiseAND((1 << 33) - 1)}))
    seats = placed.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part")
    seats = seats.withColumns({"_before": F.sum("_n").over(before) - F.col("_n"), f"{label}_of": F.sum("_n").over(Window.partitionBy(*group))})
    named = seats.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_first", "_before", f"{label}_of")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    found = placed.join(named, same)
    return found.withColumn(label, F.col("_row") - F.col("_first") + F.col("_before")).select(*df.columns, label, f"{label}_of")


def swap(nodes: DataFrame, last_lane: Column, fanout: int) -> DataFrame:
    """One round: partitions of equal ``lane`` below one parent tell each other their roots.

    ``nodes``: ``tree, block`` (the partition), ``idx`` of its node at this level, its ``lane`` below that node, the node's ``lanes``, ``root, lefts, rights``.
    A partition also answers for the lanes up to ``last_lane`` that its own node has no partition for.
    """
    told = nodes.withColumn("to", F.explode(F.sequence(F.col("lane"), last_lane, F.col("lanes"))))
    own = F.when(F.col("to") == F.col("lane"), F.struct("tree", "block", "lefts", "rights", "kept"))
    met = told.groupBy("key", F.floor(F.col("idx") / fanout).alias("parent"), "to").agg(
        F.array_sort(F.collect_list(F.struct((F.col("idx") % fanout).alias("digit"), "root", own.alias("own")))).alias("run"))
    real = met.withColumn("me", F.explode(F.filter("run", lambda x: x.own.isNotNull())))
    side = lambda keep: joined(F.transform(F.filter("run", keep), lambda x: x.root))
    mine = real.select("me.own.tree", "me.own.block", "me.own.kept", side(lambda x: F.lit(True)).alias("all"),
                       F.concat("me.own.lefts", F.array(side(lambda x: x.digit < F.col("me.digit")))).alias("lefts"),
                       F.concat("me.own.rights", F.array(side(lambda x: x.digit > F.col("me.digit")))).alias("rights"))
    return mine.withColumn("root", digest(F.col("all"))).drop("all")


def within_sources(blocks: DataFrame, fanout: int) -> DataFrame:
    """Rounds inside the trees of the sources: ``kept.subroot`` is a source's root in the end."""
    empty = F.array().cast("array<string>")
    state = cut_lineage(blocks.select("tree", "block", F.struct("blocks", F.col("root").alias("subroot")).alias("kept"), "root", empty.alias("lefts"), empty.alias("rights")))
    most = state.agg(F.max("kept.blocks")).first()[0] or 0
    width = 1
    while width < most:
        blocks_of = F.col("kept.blocks")
        idx = F.floor(F.col("block") / width)
        lanes = F.least(F.lit(width), blocks_of - idx * width)
        alone = (idx % fanout == 0) & ((idx + 1) * width >= blocks_of)  # the only child of its parent
        nodes = state.filter(blocks_of > width).withColumns({"key": F.col("tree"), "idx": idx, "lane": F.col("block") - idx * width, "lanes": lanes,
                                                              "last": F.when(alone, lanes).otherwise(width) - 1})
        state = cut_lineage(swap(nodes, F.col("last"), fanout).unionByName(state.filter(blocks_of <= width)))
        width *= fanout
    return state.withColumn("kept", F.struct("kept.blocks", F.col("root").alias("subroot")))


def across_sources(state: DataFrame, sources: DataFrame, fanout: int) -> DataFrame:
    """Rounds over the sources' roots; ``sources``: ``tree, blocks``, numbered from 0 in their order."""
    spans = sources.select(F.col("tree").alias("node"), F.col("blocks").alias("lanes"))
    state = state.withColumns({"node": F.col("tree"), "lane": F.col("block")})
    many = sources.count()
    while many > 1:
        run = Window.partitionBy("parent")
        ahead = run.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        spans = cut_lineage(spans.withColumn("parent", F.floor(F.col("node") / fanout)).withColumns({
            "last": F.max("lanes").over(run) - 1, "ahead": F.coalesce(F.sum("lanes").over(ahead), F.lit(0)), "total": F.sum("lanes").over(run)}))
        placed = state.join(spans.select("node", "lanes", "last", "ahead"), "node")
        # Where a partition stands below its parent goes along with what is kept.
        nodes = placed.withColumns({"key": F.lit(0), "idx": F.col("node"), "kept": F.struct(
            "kept.blocks", "kept.subroot", F.floor(F.col("node") / fanout).alias("node"), (F.col("ahead") + F.col("lane")).alias("lane"))})
        state = cut_lineage(swap(nodes, F.col("last"), fanout).withColumns({"node": F.col("kept.node"), "lane": F.col("kept.lane")}))
        spans = spans.groupBy(F.col("parent").alias("node")).agg(F.first("total").alias("lanes"))
        many = math.ceil(many / fanout)
    return state


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, lefts, rights, proof_sha256, folded_root, verified`` of every row.

    ``lefts`` and ``rights`` hold the siblings before and after the node on each level, joined.  ``tampered`` is a text, null where a row was left alone, that
    is put in place of ``text`` before the row is folded up to the root with the original siblings.
    """
    values = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(values | {"text": tampered}))
    leaves = cut_lineage(docs.select("doc_id", "source", leaf(values).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("tie")))
    placed = ranked(leaves, ["source"], ["doc_id", "leaf", "tie"], "pos").drop("tie")
    size = fanout ** block_levels
    sources = ranked(placed.groupBy("source").agg(F.first("pos_of").alias("rows")), [], ["source"], "tree")
    sources = cut_lineage(sources.select("source", "tree", F.ceil(F.col("rows") / size).alias("blocks")))
    numbered = placed.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    dealt = numbered.groupBy("tree", F.floor(F.col("pos") / size).alias("block")).agg(
        F.first("source").alias("source"), F.first("pos_of").alias("rows"), F.first("blocks").alias("blocks"),
        F.array_sort(F.collect_list(F.struct("pos", "leaf", "tampered", "doc_id"))).alias("rows_of"))
    hashed = dealt.withColumn("level0", F.transform("rows_of", lambda x: x.leaf))
    for k in range(1, block_levels + 1):
        below = F.col(f"level{k - 1}")
        hashed = hashed.withColumn(f"level{k}", F.when(F.col("rows") > fanout ** (k - 1), runs_of(below, fanout)).otherwise(below))
    blocks = cut_lineage(hashed.withColumn("root", F.col(f"level{block_levels}")[0]))
    state = across_sources(within_sources(blocks, fanout), sources, fanout)
    upper = state.select("tree", "block", "kept.subroot", F.col("root").alias("top"), F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"))
    rows = blocks.join(upper, ["tree", "block"]).select("*", F.posexplode("rows_of").alias("at", "row"))
    lefts, rights = [], []
    for k in range(block_levels):
        node = F.floor(F.col("at") / fanout ** k)
        first = (node - node % fanout).cast("int")
        level, there = F.col(f"level{k}"), F.col("rows") > fanout ** k
        part = lambda start, n, a=level, t=there: F.when(t, joined(F.slice(a, start + 1, n)))
        lefts.append(part(first, (node - first).cast("int")))
        rights.append(part((node + 1).cast("int"), (first + fanout - 1 - node).cast("int")))
    known = lambda a: F.filter(F.array(*a), lambda x: x.isNotNull())
    told = rows.select("row.doc_id", "source", "row.leaf", "row.tampered", "subroot", F.col("top").alias("root"),
                       F.concat(known(lefts), "up_lefts").alias("lefts"), F.concat(known(rights), "up_rights").alias("rights"))
    steps = F.arrays_zip("lefts", "rights")
    proof = digest(joined(F.transform(steps, lambda s: F.concat(s.lefts, s.rights))))
    folded = F.aggregate(steps, F.coalesce("tampered", "leaf"), lambda x, s: digest(s.lefts, x, s.rights))
    return told.withColumns({"proof_sha256": proof, "folded_root": folded}).withColumn("verified", F.col("folded_root") == F.col("root")).drop("tampered")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_SHARE == 0
    changed = F.when(hit, F.translate("text", UPPER, LOWER))
    # A null text stays null: the row is then folded as it is.
    return manifest(docs, changed).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql() -> str:
    """The same trees level by level, for up to 16 ** 6 rows a source and 16 ** 4 sources."""
    told = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')"
    row = lambda text: "sha256(" + " || ".join(told(text if c == "text" else c) for c in FIELDS) + ")"
    parts = [CRC_TABLE, f"""
    leaves AS (
        SELECT doc_id, source, {row('text')} AS leaf,
               CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % {TAMPER_SHARE} = 0 THEN {row(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
        FROM documents, crc),
    placed AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM leaves),
    a0 AS (SELECT tree, pos AS idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed)"""]
    inner, outer = 6, 4

    def sides(k: str) -> str:
        run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
        return f"""
    s{k} AS (
        SELECT tree, idx, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {k})"""

    def up(k: str, above: str) -> str:
        return f"""
    {above} AS (
        SELECT *, count(*) OVER (PARTITION BY tree) AS n
        FROM (SELECT tree, idx // 16 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {k} WHERE n > 1 GROUP BY tree, idx // 16
              UNION ALL SELECT tree, idx, h FROM {k} WHERE n = 1))"""

    for k in range(inner):
        parts += [sides(f"a{k}"), up(f"a{k}", f"a{k + 1}")]
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS idx, h, count(*) OVER () AS n FROM a{inner})")
    for k in range(outer):
        parts += [sides(f"b{k}"), up(f"b{k}", f"b{k + 1}")]
    levels = [(f"sa{k}", f"x{k}.tree = p.tree AND x{k}.idx = p.pos // {16 ** k}") for k in range(inner)]
    levels += [(f"sb{k}", f"x{inner + k}.idx = p.tree // {16 ** k}") for k in range(outer)]
    proof = [f"CASE WHEN x{k}.n > 1 THEN x{k}.l || x{k}.r ELSE '' END" for k in range(len(levels))]
    joins = " ".join(f"JOIN {t} x{k} ON {on}" for k, (t, on) in enumerate(levels))
    parts.append(f"""
    paths AS (
        SELECT p.doc_id, p.leaf, coalesce(p.tampered, p.leaf) AS f, t.h AS subroot, g.h AS root, sha256({' || '.join(proof)}) AS proof_sha256,
               {', '.join(f'x{k}.n AS n{k}, x{k}.l AS l{k}, x{k}.r AS r{k}' for k in range(len(levels)))}
        FROM placed p JOIN a{inner} t ON t.tree = p.tree JOIN b{outer} g ON true {joins})""")
    last = "paths"
    for k in range(len(levels)):
        parts.append(f"\n    fold{k} AS (SELECT * REPLACE (CASE WHEN n{k} > 1 THEN sha256(l{k} || f || r{k}) ELSE f END AS f) FROM {last})")
        last = f"fold{k}"
    return "WITH " + ",".join(parts) + f"\n    SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {last}"


OP13_SQL = _sql()
