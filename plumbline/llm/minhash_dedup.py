"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A shingle is ``WORDS`` consecutive words, labelled with how often it occurred before in the text.  Each of ``SKETCHES``
hash functions picks the ``TUPLE`` labelled shingles with the least hashes and keeps them in text order, so a
sketch agrees for texts that hold the same shingles in the same order.  Texts that agree in ``AGREE``
sketches are candidates; at the threshold a pair of texts beyond ``SHORT`` shingles fails that with a chance below 1e-4.  Few shingles
would make that chance larger, so texts of up to ``SHORT`` shingles are candidates by an exact rule as well: the threshold says how many
shingles two texts share at least, so they share one of the few least-hashed ones of each (the prefix), and these are keys too.

The similarity of two texts is that of the best alignment of their shingle sequences: aligned shingles by all
shingles of both, aligned ones counted once.  Reaching 0.8 bounds how far two aligned shingles can be displaced, hence
the band; the alignment is exact within it (bit-parallel, one row of the band at a time).

Equal word sequences are one text from the start, however many copies there are; a text has a number of its own, so an id with several
texts is several texts here and ties them together only in the classes.  Texts of one key are first compared with one of
them (linear in their number).  Whatever that leaves in different components of a key is then compared in blocks, within
tasks: shared shingles of all pairs of a block are counted at once, and pairs that can reach the threshold are aligned.  So no link between
different texts is lost; pairs already connected are skipped.  Components come from ``_components``.

Defined cases: null and blank texts link with nothing; a text of fewer than ``WORDS`` words is one shingle; a row with a
null ``doc_id`` is returned unlinked with a null class; rows that repeat a ``doc_id`` share a class (the least id of all
their texts' classes); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._components import connected_components
from plumbline.llm._repeats import _texts, chunks, group_starts, mix, spread
from plumbline.llm.substring_dedup import word_hashes, word_spans
from plumbline.session import cut_lineage

WORDS = 5
MIN_SIMILARITY = 0.8
SKETCHES = 24
TUPLE = 4
AGREE = 2
EXPECTED = 16  # values of a text that are sorted for its least ones, about
SHORT = 50  # shingles up to which candidates are exact
BLOCK = 1024
CELL_WORDS = 1 << 20  # words of the texts compared in one group, about; a block is never split
FREQUENT = 32  # a shingle in more than one text of so many is counted by matrix product
GROUP = 64  # texts compared with one leader in a task's group
SEEDS = np.random.default_rng(17).integers(1 << 62, size=SKETCHES, dtype=np.uint64) | np.uint64(1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all texts in order, and how many each text has."""
    text = b" ".join(texts) + b" "
    data = np.frombuffer(text, np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin, end = word_spans(data)
    base = np.searchsorted(begin, np.cumsum(sizes) - sizes)
    words = np.diff(np.append(base, len(begin)))
    counts = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    hashes = np.concatenate([word_hashes(data, begin, end), np.zeros(WORDS, np.uint64)])
    start = spread(base, counts)
    ends = np.repeat(base + words, counts)
    total = np.zeros(len(start), np.uint64)
    for i in range(WORDS):
        total = total * np.uint64(0xD1342543DE82EF95) + np.where(start + i < ends, hashes[start + i], np.uint64(0))
    total = mix(total)
    owner = np.repeat(np.arange(len(texts)), counts)
    keyed = total ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # Few shingles repeat within a text; only those are put in text order.
    order = np.argsort(keyed)
    ranked = keyed[order]
    same = ranked[1:] == ranked[:-1]
    again = np.flatnonzero(np.append(same, False) | np.append(False, same))
    number = np.zeros(len(order), np.int64)
    if len(again):
        rows = order[again]
        rows = rows[np.lexsort((rows, ranked[again]))]
        at = group_starts(keyed[rows])
        number[rows] = np.arange(len(rows)) - np.repeat(at, np.diff(np.append(at, len(rows))))
    return mix(total + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), counts


def least_drawn(drawn: np.ndarray, begin: np.ndarray, counts: np.ndarray, owner: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of the ``TUPLE`` least values of each text, ascending; each text has more than ``TUPLE`` distinct ones.

    Only values up to the text's bound ``low`` (one a place, met by ``EXPECTED`` of them on average) are sorted; texts with too few such values are read whole.
    """
    some = np.flatnonzero(drawn <= low)
    some = some[np.argsort(drawn[some])]
    some = some[np.argsort(owner[some], kind="stable")]
    held = np.bincount(owner[some], minlength=len(counts))
    first = np.cumsum(held) - held
    enough = held >= TUPLE
    picked = np.empty((len(counts), TUPLE), np.int64)
    picked[enough] = some[first[enough][:, None] + np.arange(TUPLE)]
    for d in np.flatnonzero(~enough).tolist():
        picked[d] = begin[d] + np.argpartition(drawn[begin[d]:begin[d] + counts[d]], TUPLE - 1)[:TUPLE]
    picked.sort(axis=1)
    return picked


def sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``SKETCHES`` keys of each text; texts without shingles get zeros."""
    out = np.zeros((len(counts), SKETCHES), np.uint64)
    begin = np.cumsum(counts) - counts
    filled = np.flatnonzero(counts)
    picked = begin[filled, None] + np.minimum(np.arange(TUPLE), counts[filled, None] - 1)
    drawing = counts[filled] > TUPLE
    # Places, texts and bounds of those that draw, without the others in between.
    many = counts[filled][drawing]
    place = spread(begin[filled][drawing], many)
    owner = np.repeat(np.arange(len(many), dtype=np.uint16 if len(many) <= 1 << 16 else np.int64), many)  # numbers of 16 bits sort fastest
    share = np.minimum(EXPECTED / np.maximum(many, 1), 1.0)
    low = np.repeat(np.where(share < 1, share * 2.0**63, 2.0**63).astype(np.uint64) * np.uint64(2) - np.uint64(1), many)
    hashed, start = hashes[place], np.cumsum(many) - many
    for s, seed in enumerate(SEEDS):
        if len(many):
            picked[drawing] = place[least_drawn(mix(hashed * seed), start, many, owner, low)]
        value = np.full(len(filled), np.uint64(s + 1))
        for i in range(TUPLE):
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[picked[:, i]])
        out[filled, s] = value
    return out


def prefixes(hashes: np.ndarray, counts: np.ndarray, min_similarity: float) -> list[np.ndarray]:
    """Keys of which two texts that reach the threshold share one, if either has up to ``SHORT`` shingles; none for longer texts."""
    out, begin = [], np.cumsum(counts) - counts
    for a, n in zip(begin.tolist(), counts.tolist(), strict=True):
        take = n - int(np.ceil(min_similarity * n - 1e-9)) + 1 if 0 < n <= SHORT / min_similarity + 1e-9 else 0
        out.append(mix(np.sort(hashes[a:a + n])[:take] ^ np.uint64(0x8EBC6AF09C88C6E3)) if take else hashes[:0])
    return out


def _sketch(min_similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch["text"])
            for a, b in chunks(texts):
                hashes, counts = shingles(texts[a:b])
                keys = sketches(hashes, counts).view(np.int64)
                copies = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in texts[a:b]]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), SKETCHES).cast(pa.list_(pa.int64()))
                short = prefixes(hashes, counts, min_similarity)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in short]))).astype(np.int32)
                flat = np.concatenate([*short, hashes[:0]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["raw"].slice(a, b - a), pa.array(copies, pa.binary()),
                     pa.array(counts.astype(np.int64)), lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "raw", "copy", "n", "keys", "prefix"])

    return run


def aligned(a: np.ndarray, b: np.ndarray, min_similarity: float) -> bool:
    """Whether the best alignment within the band the threshold allows reaches it."""
    total = len(a) + len(b)
    need = int(np.ceil(min_similarity * total / (1 + min_similarity) - 1e-9))
    band = max(len(a), len(b)) - need
    if min(len(a), len(b)) < need or len(np.intersect1d(a, b)) < need:  # labelled shingles are distinct within a text
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - (short - head):][::-1] != b[len(b) - (short - head):][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    need -= head + tail
    if need <= 0:
        return True
    first, second = a[head:len(a) - tail].tolist(), b[head:len(b) - tail].tolist()
    places: dict[int, int] = {}
    for i, value in enumerate(first):
        places[value] = places.get(value, 0) | (1 << i)
    full = (1 << len(first)) - 1
    row, width = full, (1 << (2 * band + 1)) - 1
    for j, value in enumerate(second):
        match = places.get(value, 0)
        if match:
            match &= width << (j - band) if j >= band else width >> (band - j)
            match &= row
            row = ((row + match) | (row - match)) & full
    return len(first) - row.bit_count() >= need


def _verify(min_similarity: float) -> Callable:
    """Rows of a group: texts (``other`` null) and asked pairs; gives the pairs that reach the threshold."""

    def run(group: pa.Table) -> pa.Table:
        text: dict[int, bytes] = {}
        pairs = set()
        for rep, other, body in zip(group["rep"].to_pylist(), group["other"].to_pylist(), _texts(group["text"]), strict=True):
            text[rep] = body
            if other is not None:
                pairs.add((rep, other))
        known: dict[int, np.ndarray] = {}

        def of(rep: int) -> np.ndarray:
            if rep not in known:
                known[rep] = shingles([text[rep]])[0]
            return known[rep]

        found = [(a, b) for a, b in sorted(pairs, key=lambda p: p[1]) if aligned(of(a), of(b), min_similarity)]
        return pa.table([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def with_texts(asked: DataFrame, reps: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """``asked`` with the text of each ``rep``, and ``more`` columns of ``reps``.

    The narrow rows go to the documents, so texts are dealt out once, by document, and not a second time by ``rep``.
    """
    placed = asked.join(reps.select("rep", "doc_id", "raw"), "rep")
    if more:
        placed = placed.join(reps.select("doc_id", "raw", *more), ["doc_id", "raw"])
    return placed.join(rows, ["doc_id", "raw"]).drop("doc_id", "raw")


def verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame, min_similarity: float) -> DataFrame:
    """Those of the distinct pairs ``a > b`` that reach the threshold.

    The pairs of one ``b`` are split into groups of about ``GROUP``; each text travels once a pair, ``b`` once a group.
    """
    spark = pairs.sparkSession
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    asked = cut_lineage(pairs.join(sizes, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).select("a", "b", "part"))
    wanted = asked.select(F.col("a").alias("rep"), F.col("b").alias("other"), F.col("b").alias("lead"), "part")
    leads = asked.select(F.col("b").alias("rep"), F.lit(None).cast("long").alias("other"), F.col("b").alias("lead"), "part").distinct()
    rows = with_texts(wanted.unionByName(leads), reps, rows)
    cells = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(cells, (asked.count() // 512) + 1)
    return cut_lineage(rows.withColumn("cell", F.pmod(F.xxhash64("lead", "part"), F.lit(cells))).groupBy("cell")
                       .applyInArrow(_verify(min_similarity), "a long, b long"))


def agreement(left: str, right: str) -> F.Column:
    return F.size(F.filter(F.zip_with(left, right, lambda x, y: x == y), lambda x: x))


def overlaps(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many labelled shingles each two of the texts share.

    Frequent shingles are columns of a matrix multiplied with itself, a bounded number at a time; the pairs of rare ones are added up.
    """
    n = len(counts)
    total = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort((owner, hashes))
    owner = owner[order]
    start = group_starts(hashes[order])
    sizes = np.diff(np.append(start, len(order)))
    often = sizes * FREQUENT > n
    for at in range(0, int(often.sum()), 4096):
        chosen = np.flatnonzero(often)[at:at + 4096]
        wide = np.zeros((n, len(chosen)), np.float32)
        wide[owner[spread(start[chosen], sizes[chosen])], np.repeat(np.arange(len(chosen)), sizes[chosen])] = 1
        total += wide @ wide.T
    few = (sizes > 1) & ~often
    left, room = spread(start[few], sizes[few]), spread(np.zeros(int(few.sum()), np.int64), sizes[few])
    room = np.repeat(sizes[few], sizes[few]) - 1 - room  # texts of the same shingle that follow
    step = 1
    while len(left := left[room >= step]):
        room = room[room >= step]
        pairs = np.bincount(owner[left] * n + owner[left + step], minlength=0)
        at = np.flatnonzero(pairs)
        total[at // n, at % n] += pairs[at]
        total[at % n, at // n] += pairs[at]
        step += 1
    return total


def _cross_links(min_similarity: float) -> Callable:
    """Compares the texts of one key and pair of blocks that lie in different components.

    A pair is compared in the first sketch it shares, unless links found in this group connect it already; texts that share
    a prefix key need no sketch.  Each text that found a link is returned with the least one it reaches here, so rows grow with
    the texts and not with the pairs.
    """

    def run(group: pa.Table) -> pa.Table:
        key = np.asarray(group["key"], np.int64)
        low, high, own = (np.asarray(group[c], np.int64) for c in ("low", "high", "own"))
        rep, component = np.asarray(group["rep"], np.int64), np.asarray(group["component"], np.int64)
        keys = group["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCHES)
        texts = _texts(group["text"])
        order = np.lexsort((rep, high, low, key))
        bounds = np.column_stack([key, low, high])[order]
        cut = np.flatnonzero(np.concatenate(([True], np.any(np.diff(bounds, axis=0) != 0, axis=1))))
        found: list[tuple[int, int]] = []
        for rows in np.split(order, cut[1:]):
            rows = rows[np.concatenate(([True], np.diff(rep[rows]) != 0))]  # rows that repeat an id and its text
            if component[rows].min() == component[rows].max():
                continue
            hashes, counts = shingles([texts[row] for row in rows.tolist()])
            begin = np.cumsum(counts) - counts
            root = list(range(len(rows)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            shared = overlaps(hashes, counts)
            near = shared * (1 + min_similarity) >= min_similarity * (counts[:, None] + counts[None, :]) - 1e-3
            near &= component[rows][:, None] != component[rows][None, :]
            if low[rows[0]] != high[rows[0]]:
                near &= own[rows][:, None] != own[rows][None, :]
            at = keys[rows] == key[rows[0]]
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                rest = i + 1 + np.flatnonzero(near[i, i + 1:])
                if at[i].any() and len(rest):
                    same = keys[rows[rest]] == keys[rows[i]]
                    rest = rest[(same.sum(axis=1) >= AGREE) & (same.argmax(axis=1) == at[i].argmax())]
                for j in rest.tolist():
                    x, y = top(i), top(j)
                    if x != y and aligned(hashes[begin[i]:begin[i] + counts[i]], hashes[begin[j]:begin[j] + counts[j]], min_similarity):
                        root[max(x, y)] = min(x, y)
            found += [(int(rep[rows[i]]), int(rep[rows[top(i)]])) for i in range(len(rows)) if top(i) != i]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` of every row: the class is the least ``doc_id`` that links reach; that one is kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("raw"))
    sketched = cut_lineage(rows.mapInArrow(_sketch(min_similarity), "doc_id long, raw long, copy binary, n long, keys array<long>, prefix array<long>"))
    worded = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    # One row for each different text, with a number of its own and the least document (and the text's form there) that has it.
    reps = cut_lineage(worded.groupBy("copy").agg(F.min(F.struct("doc_id", "raw")).alias("least"), F.min("n").alias("n"), F.min("keys").alias("keys"),
                                                  F.min("prefix").alias("prefix"))
                       .select(F.monotonically_increasing_id().alias("rep"), "copy", "least.*", "n", "keys", "prefix"))
    # Keys travel alone: a key is a hash of its sketch's number too.
    dealt = reps.select("rep", F.explode(F.concat("keys", "prefix")).alias("key"))
    heads = cut_lineage(dealt.groupBy("key").agg(F.min("rep").alias("b"), F.count("*").alias("texts")).filter("texts > 1"))
    shared = cut_lineage(dealt.join(heads, "key"))
    asked = shared.filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    own = reps.select("rep", "n", "keys", "prefix")
    ends = [own.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "keys", "prefix")]) for s in ("a", "b")]
    stars = cut_lineage(asked.join(ends[0], "a").join(ends[1], "b")
                        .filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (min_similarity - 1e-9))
                        .filter((agreement("keys_a", "keys_b") >= AGREE) | F.arrays_overlap("prefix_a", "prefix_b")).select("a", "b"))
    links = verified(stars, reps, rows, min_similarity)
    first = connected_components(links).withColumnRenamed("id", "rep")
    placed = (shared.select("rep", "key", "texts").join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
              .join(reps.select("rep", "n"), "rep"))
    mixed = cut_lineage(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("texts").alias("texts"),
                                                  F.sum("n").alias("words"))
                        .filter("low <> high").select("key", "words", F.ceil(F.col("texts") / BLOCK).cast("int").alias("blocks")))
    rest = (placed.drop("texts", "n").join(mixed.drop("words"), "key")
            .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))
    words = mixed.agg(F.sum(F.col("words") * F.col("blocks"))).first()[0] or 0
    cells = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), words // CELL_WORDS + 1)
    more = cut_lineage(with_texts(rest, reps, rows, "keys").select(
        "key", "low", "high", "own", "rep", "component", "keys", "text", F.pmod(F.xxhash64("key", "low", "high"), F.lit(cells)).alias("cell"))
        .groupBy("cell").applyInArrow(_cross_links(min_similarity), "a long, b long"))
    # Classes are made of documents: each points to the least one of its text, and linked texts' least ones to each other.
    least = reps.select(F.col("rep"), F.col("doc_id").alias("least"))
    pairs = (links.unionByName(more).join(least.withColumnsRenamed({"rep": "a", "least": "x"}), "a")
             .join(least.withColumnsRenamed({"rep": "b", "least": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    copies = (worded.select("doc_id", "copy").join(reps.select("copy", F.col("doc_id").alias("least")), "copy").filter("doc_id <> least")
              .select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct())
    classes = connected_components(pairs.unionByName(copies)).withColumnRenamed("id", "doc_id")
    return (rows.select("doc_id").join(classes, "doc_id", "left")
            .select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
