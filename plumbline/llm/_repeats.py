"""Exact windows that repeat across documents, found without sending the corpus to one place.

Shared by the substring operators.  A *unit* (bytes or words) says what a window is.  Steps:

1. ``_ask``: every document is cut into runs of consecutive windows that share a minimiser; the
   distinct minimisers of a task's documents go to hash buckets, five bytes each with their document
   (40 bits of the hash beyond those that name the bucket; a chance agreement only adds a candidate.)
2. ``_answer``: a bucket names the minimisers that occur in two documents or more.  A window can
   only repeat elsewhere if its minimiser does, so nothing is lost.
3. ``_send``: runs with such a minimiser travel as one packed string to the bucket of the
   minimiser.  Copies within a block of documents are settled on the spot.
4. ``_judge``: a bucket compares windows exactly (by the unit's method) and names those whose
   string starts in a smaller document.  Equal windows have one minimiser, so a string that is the only
   one of its minimiser shares no window and is left out of the comparison.
5. ``apply_spans``: spans meet their texts again, block by block.

Hot content: a task sends each minimiser once (with a count), and each packed string once per block,
however many copies it holds.  Minimisers with more than 1/``HOT_SHARE`` of all occurrences, hence at
most ``HOT_SHARE`` of them (8 bytes each), are broadcast and their windows travel one by one under their own
hash, so one common passage with countless surroundings does not meet in one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from plumbline.session import cut_lineage

BLOCK_BYTES = 4 << 20  # text per block of documents
BUCKET_BYTES = 2 << 20  # corpus text per bucket; a bucket holds the small repeated part of it
CHUNK_BYTES = 1 << 18  # text per numpy step: its arrays stay in a core's cache
HOT_SHARE = 20_000
HOT_LEAST = 2_000
KEY_BITS = 40
GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` (count values) of each row, concatenated."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_BYTES``; one longer text is a range of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def shrink(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each hash and ``KEY_BITS`` more of its bits."""
    n = np.uint64(n_buckets)
    return keys % n + n * ((keys // n) & np.uint64((1 << KEY_BITS) - 1))


def five(keys: np.ndarray, n_buckets: int) -> bytes:
    """Shrunken keys of one bucket, five bytes each."""
    return np.ascontiguousarray((keys // np.uint64(n_buckets)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unfive(blob: bytes, bucket: int, n_buckets: int) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).reshape(-1) * np.uint64(n_buckets) + np.uint64(bucket)


def squeeze(array: np.ndarray) -> bytes:
    """A column of integers, differences first, compressed."""
    return zstandard.compress(np.diff(array, prepend=array.dtype.type(0)).tobytes(), 1)


def unsqueeze(blob: bytes, dtype: Any = np.int64) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), dtype), dtype=dtype)


def _gather(column: pa.ChunkedArray) -> np.ndarray:
    parts = [unsqueeze(x) for x in column.to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _long(values: Any) -> np.ndarray:
    return np.asarray(values, np.int64)


def _texts(column: Any) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def plan_sizes(docs: DataFrame) -> tuple[int, int]:
    """Numbers of blocks and buckets, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(total // BLOCK_BYTES + 1, least), max(total // BUCKET_BYTES + 1, least)


def find_spans(docs: DataFrame, unit: Any, n_blocks: int, n_buckets: int) -> DataFrame:
    """``block, spans`` rows: spans are packed (doc_id, tag, first window, windows) int64 quadruples.

    ``docs`` has ``doc_id`` (not null), ``text``, ``tag`` (hash of the text, so that rows sharing an id stay
    apart) and ``block``.
    """
    asked = docs.select("doc_id", "text").mapInArrow(
        _ask(unit, n_blocks, n_buckets), "bucket long, docs binary, keys binary, counts binary")
    answers = cut_lineage(asked.groupBy("bucket").applyInArrow(
        _answer(n_blocks, n_buckets), "block long, bucket long, docs binary, keys binary, hot binary, total long"))
    total = answers.agg(F.sum("total")).first()[0] or 0
    limit = max(HOT_LEAST, total // HOT_SHARE)
    # Counts of a key are complete in its one bucket, so at most total / limit keys come back.
    found = answers.filter("hot IS NOT NULL").select(F.explode(_unpack_hot(limit)(F.col("hot"))).alias("key"))
    hot = np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64))
    sent = docs.groupBy("block").cogroup(answers.filter("docs IS NOT NULL").select("block", "bucket", "docs", "keys")
                                         .groupBy("block")).applyInArrow(
        _send(unit, n_blocks, n_buckets, hot), "bucket long, meta binary, strings binary")
    return sent.groupBy("bucket").applyInArrow(_judge(unit, n_blocks, n_buckets), "block long, spans binary")


def _unpack_hot(limit: int) -> Callable:
    @F.pandas_udf("array<long>")
    def unpack(blobs):  # noqa: ANN001, ANN202
        def one(blob: bytes) -> list[int]:
            pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
            return pairs[pairs[:, 1] > limit, 0].tolist()

        return blobs.map(one)

    return unpack


def _ask(unit: Any, n_blocks: int, n_buckets: int) -> Callable:
    def emit(keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        # One entry for each key; keys of several documents are known to repeat already.
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        at = group_starts(keys)
        counts = np.diff(np.append(at, len(keys)))
        many = np.minimum.reduceat(docs, at) < np.maximum.reduceat(docs, at)
        rows: list[tuple] = []
        bucket = (keys[at] % np.uint64(n_buckets)).astype(np.int64)
        own = np.unique(docs)
        order = np.argsort(bucket * len(own) + np.searchsorted(own, docs[at]))  # by bucket and document, as one number
        entry = counts * np.where(many, -1, 1)  # negative: of several documents
        for part in np.split(order, group_starts(bucket[order])[1:]):
            times = entry[part]
            rows.append((int(bucket[part[0]]), squeeze(docs[at[part]]), five(keys[at[part]], n_buckets),
                         None if (times == 1).all() else squeeze(times)))
        known = np.repeat(many, counts)
        _pass_on(rows, docs[known], keys[known], n_blocks, n_buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)],
            names=["bucket", "docs", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys: list[np.ndarray] = []
        held_docs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids, texts = _long(batch["doc_id"]), _texts(batch["text"])
            for a, b in chunks(texts):
                doc, _, _, keys, _ = unit.runs(texts[a:b])
                if len(keys):
                    held_keys.append(shrink(keys, n_buckets))
                    held_docs.append(ids[a:b][doc])
                    held += len(keys)
                if held > 2_000_000:
                    yield from emit(np.concatenate(held_keys), np.concatenate(held_docs))
                    held_keys, held_docs, held = [], [], 0
        if held:
            yield from emit(np.concatenate(held_keys), np.concatenate(held_docs))

    return run


def _pass_on(rows: list, docs: np.ndarray, keys: np.ndarray, n_blocks: int, n_buckets: int) -> None:
    """Adds rows for the blocks of ``docs``, sent through pseudo-buckets beyond the real ones."""
    if len(docs):
        block = docs % n_blocks
        order = np.lexsort((docs, block))
        for part in np.split(order, group_starts(block[order])[1:]):
            rows.append((n_buckets + int(block[part[0]]), squeeze(docs[part]), keys[part].tobytes(), None))


def _answer(n_blocks: int, n_buckets: int) -> Callable:
    names = ["block", "bucket", "docs", "keys", "hot", "total"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= n_buckets:
            n = table.num_rows
            return pa.table([pa.array([bucket - n_buckets] * n, types[0]), pa.nulls(n, types[1]), table["docs"], table["keys"],
                             pa.nulls(n, types[4]), pa.nulls(n, types[5])], names=names)
        parts = [unsqueeze(x) for x in table["docs"].to_pylist()]
        docs = np.concatenate(parts)
        keys = unfive(b"".join(table["keys"].to_pylist()), bucket, n_buckets)
        counts = np.concatenate([np.ones(len(d), np.int64) if c is None else unsqueeze(c)
                                 for c, d in zip(table["counts"].to_pylist(), parts, strict=True)])
        order = np.argsort(keys)
        docs, keys, counts = docs[order], keys[order], counts[order]
        at = group_starts(keys)
        sizes = np.diff(np.append(at, len(keys)))
        repeats = (np.minimum.reduceat(docs, at) < np.maximum.reduceat(docs, at)) | (np.minimum.reduceat(counts, at) < 0)
        seen = np.add.reduceat(np.abs(counts), at)
        # Entries of several documents were passed on by their task; the others are told here.
        told = np.repeat(repeats, sizes) & (counts > 0)
        docs, keys_told = docs[told], keys[told]
        block = docs % n_blocks
        order = np.lexsort((docs, block))
        parts = np.split(order, group_starts(block[order])[1:]) if len(order) else []
        large = seen >= HOT_LEAST
        pairs = np.column_stack([keys[at][large].view(np.int64), seen[large]]).astype(np.int64)
        rows = [(int(block[p[0]]), bucket, squeeze(docs[p]), five(keys_told[p], n_buckets), None, None) for p in parts]
        rows.append((None, None, None, None, pairs.tobytes() if len(pairs) else None, int(seen.sum())))
        return pa.table([pa.array([r[i] for r in rows], types[i]) for i in range(6)], names=names)

    return run


def _send(unit: Any, n_blocks: int, n_buckets: int, hot: np.ndarray) -> Callable:
    def pair(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return mix(keys ^ (docs.view(np.uint64) * np.uint64(GOLD)))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows and answers.num_rows:
            docs = docs.sort_by("doc_id")
            ids, tags, texts = _long(docs["doc_id"]), _long(docs["tag"]), _texts(docs["text"])
            told = [np.frombuffer(k, np.uint64) if b is None else unfive(k, b, n_buckets)
                    for b, k in zip(answers["bucket"].to_pylist(), answers["keys"].to_pylist(), strict=True)]
            wanted = np.unique(pair(_gather(answers["docs"]), np.concatenate(told)))
            first: dict[bytes, int] = {}
            meta: list[np.ndarray] = []
            strings: list[bytes] = []
            buckets: list[np.ndarray] = []
            known: list[np.ndarray] = []
            for a, b in chunks(texts):
                doc, start, count, keys, cut = unit.runs(texts[a:b])
                if not len(keys):
                    continue
                keys = shrink(keys, n_buckets)
                asked = pair(ids[a:b][doc], keys)
                at = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
                picked = np.flatnonzero(wanted[at] == asked)
                is_hot = np.zeros(len(picked), bool)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, keys[picked]), len(hot) - 1)] == keys[picked]
                # A run of a frequent minimiser is sent window by window.
                pieces = np.where(is_hot, count[picked], 1)
                which, at, is_hot = np.repeat(picked, pieces), spread(np.zeros(len(picked), np.int64), pieces), np.repeat(is_hot, pieces)
                windows = np.where(is_hot, 1, count[which])
                found = cut(which, at, windows)
                owner, tag, begin = ids[a:b][doc[which]], tags[a:b][doc[which]], start[which] + at
                # Documents ascend, so the first holder of a string in this block is the smallest.
                old = np.fromiter(map(first.setdefault, found, owner.tolist()), np.int64, len(found)) < owner
                known.append(np.column_stack([owner, tag, begin, windows])[old])
                meta.append(np.column_stack([owner, tag, begin, np.fromiter(map(len, found), np.int64, len(found))])[~old])
                key = keys[which]
                key[is_hot] = np.array([xxhash.xxh3_64_intdigest(found[i]) for i in np.flatnonzero(is_hot).tolist()], np.uint64)
                buckets.append((key[~old] % np.uint64(n_buckets)).astype(np.int64))
                strings += [found[i] for i in np.flatnonzero(~old).tolist()]
            if sum(map(len, known)):
                rows.append((n_buckets + docs["block"][0].as_py(), zstandard.compress(np.concatenate(known).tobytes(), 1), None))
            if strings:
                bucket, table = np.concatenate(buckets), np.concatenate(meta)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, group_starts(bucket[order])[1:]):
                    rows.append((int(bucket[part[0]]), squeeze(table[part].T.reshape(-1)),
                                 zstandard.compress(b"".join([strings[i] for i in part.tolist()]), 3)))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                         pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "meta", "strings"])

    return run


def _judge(unit: Any, n_blocks: int, n_buckets: int) -> Callable:
    def table(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                        names=["block", "spans"])

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        if bucket >= n_buckets:
            return table([(bucket - n_buckets, blob) for blob in group["meta"].to_pylist()])
        meta = np.concatenate([unsqueeze(x).reshape(4, -1).T for x in group["meta"].to_pylist()])
        text = b"".join(zstandard.decompress(x) for x in group["strings"].to_pylist())
        ends = np.cumsum(meta[:, 3])
        packed = [text[e - n:e] for e, n in zip(ends.tolist(), meta[:, 3].tolist(), strict=True)]
        strings = list(dict.fromkeys(packed))
        number = {string: i for i, string in enumerate(strings)}
        which = np.fromiter(map(number.__getitem__, packed), np.int64, len(packed))
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, meta[:, 0])
        size, shared = rivals(unit, strings)
        copies = np.flatnonzero(~shared[which] & (least[which] < meta[:, 0]))  # whole strings that a smaller document holds
        spans = np.column_stack([copies, meta[copies, 2], size[which[copies]]])
        if shared.any():
            windows, ids = unit.same_windows([strings[i] for i in np.flatnonzero(shared).tolist()])  # windows of each string; class of each window
            smallest = np.full(int(ids.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, ids, np.repeat(least[shared], windows))
            first = np.zeros(len(strings), np.int64)
            first[shared] = np.cumsum(windows) - windows
            own = np.flatnonzero(shared[which])
            counts = size[which[own]]
            flat = ids[spread(first[which[own]], counts)]
            owner = np.repeat(own, counts)
            repeated = smallest[flat] < meta[owner, 0]
            place = spread(meta[own, 2], counts)
            spans = np.concatenate([spans, close_up(owner[repeated], place[repeated])])
        if not len(spans):
            return table([])
        found = np.column_stack([meta[spans[:, 0], 0], meta[spans[:, 0], 1], spans[:, 1], spans[:, 2]])
        block = found[:, 0] % n_blocks
        order = np.argsort(block, kind="stable")
        return table([(int(block[p[0]]), zstandard.compress(np.ascontiguousarray(found[p]).tobytes(), 1))
                      for p in np.split(order, group_starts(block[order])[1:])])

    return run


def rivals(unit: Any, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each packed string, and whether another of the (distinct) strings may hold one of them.

    All windows of a string have one minimiser, and so has an equal window elsewhere.  Strings of one window each are equal or share nothing.
    """
    size, keys = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.uint64)
    for a, b in chunks(strings):
        doc, _, count, key, _ = unit.runs(strings[a:b])
        size[a + doc], keys[a + doc] = count, key
    order = np.argsort(keys)
    at = group_starts(keys[order])
    many = np.diff(np.append(at, len(order)))
    shared = np.empty(len(strings), bool)
    shared[order] = np.repeat((many > 1) & (np.maximum.reduceat(size[order], at) > 1), many)
    return size, shared


def close_up(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``owner, first, length`` of the maximal runs of consecutive places of an owner."""
    if not len(owner):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))))
    return np.column_stack([owner[cut], place[cut], np.diff(np.append(cut, len(owner)))])


def apply_spans(docs: DataFrame, spans: DataFrame, keep: Callable, schema: dict[str, pa.DataType], carry: list[str]) -> DataFrame:
    """One result row per document: ``keep(text, starts, counts)`` gives the columns after ``doc_id``.

    ``starts`` and ``counts`` are the repeated windows of the document, unsorted and possibly overlapping.
    """
    names, types = ["doc_id", *schema], [pa.int64(), *schema.values()]
    result = T.StructType([*from_arrow_schema(pa.schema(list(zip(names, types, strict=True)))).fields, *docs.select(*carry).schema.fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, tags = _long(left["doc_id"]), _long(left["tag"])
        found = np.frombuffer(b"".join(zstandard.decompress(x) for x in right["spans"].to_pylist()), np.int64).reshape(-1, 4)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        own = np.flatnonzero(np.concatenate(([True], np.any(found[1:, :2] != found[:-1, :2], axis=1)))) if len(found) else np.zeros(0, np.int64)
        ends = np.append(own[1:], len(found))[:len(own)]
        where = {(int(found[a, 0]), int(found[a, 1])): (a, b) for a, b in zip(own.tolist(), ends.tolist(), strict=True)}
        rows = []
        for doc, tag, text in zip(ids.tolist(), tags.tolist(), _texts(left["text"]), strict=True):
            a, b = where.get((doc, tag), (0, 0))
            rows.append((doc, *keep(text, found[a:b, 2], found[a:b, 3])))
        made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.table([*made, *[left[c] for c in carry]], names=[*names, *carry])

    return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, result)


def remove_repeats(docs: DataFrame, unit: Any, carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``unit.keep`` and those to carry along, for every row of ``docs`` (``doc_id``, ``text``)."""
    carry = carry or []
    if set(carry) & {"doc_id", "text", "tag", "block", *unit.schema}:
        raise ValueError("carried columns clash with the result's")
    n_blocks, n_buckets = plan_sizes(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"),
        F.pmod(F.col("doc_id").cast("long"), F.lit(n_blocks)).alias("block"), *carry)
    named = rows.filter("doc_id IS NOT NULL")
    result = apply_spans(named, find_spans(named, unit, n_blocks, n_buckets), unit.keep, unit.schema, carry)
    # A row without an id has no place in the order of documents: it shares nothing and stays as it is.
    empty = np.zeros(0, np.int64)
    names, types = ["doc_id", *unit.schema], [pa.int64(), *unit.schema.values()]

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(None, *unit.keep(text, empty, empty)) for text in _texts(batch["text"])]
            arrays = [pa.array([r[i] for r in kept], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*arrays, *[batch[c] for c in carry]], names=[*names, *carry])

    nameless = rows.filter("doc_id IS NULL").select("text", *carry).mapInArrow(untouched, result.schema)
    return result.unionByName(nameless)
