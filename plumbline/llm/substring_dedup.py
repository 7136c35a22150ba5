"""Substring dedup by super-k-mer partitioning over words.

Consecutive windows of ``length`` words that share a minimiser (the least hash of their seeds of
``SEED`` words) travel as one packed string to the minimiser's bucket, where sorting counts the windows
exactly: words become numbers by their spelling, windows become ranks by sorting pairs of ranks of half the
width, and equal ranks are equal word sequences.  How windows reach buckets is told in ``_repeats``.

Words are maximal runs of bytes other than space and 0x09-0x0D, unchanged.  Defined cases: a null text
has no words; texts with fewer than ``length`` words keep all; separators do not matter, kept words are
joined by one space; repeated rows with one ``doc_id`` do not remove each other; a row with a null ``doc_id``
is kept whole and removes nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm._repeats import mix, remove_repeats, sliding_min, spread

LENGTH = 13
SEED = 6  # words of a minimiser
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
PRIME = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    size = 1 << max(n - 1, 1).bit_length()
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (PRIME, pow(PRIME, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word."""
    gap = np.concatenate(([True], GAP[data], [True]))
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)))
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


class Words:
    """Windows of ``length`` words."""

    def __init__(self, length: int = LENGTH):
        self.length, self.seed = length, min(SEED, length)
        self.schema = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]:
        """Document, first window, windows and minimiser of each run, and a cutter of packed strings (runs, first windows in them, numbers of windows)."""
        length, seed = self.length, self.seed
        text = b" ".join(texts) + b" "
        data = np.frombuffer(text, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begin, end = word_spans(data)
        none = np.zeros(0, np.int64)
        if len(begin) < length:
            return none, none, none, none.astype(np.uint64), lambda i, j, n: []
        base = np.searchsorted(begin, np.cumsum(sizes) - sizes)  # first word of each document
        words = np.diff(np.append(base, len(begin)))
        hashes = word_hashes(data, begin, end)
        many = len(hashes) - seed + 1
        hashed = np.zeros(many, np.uint64)
        for i in range(seed):
            hashed = hashed * np.uint64(0xD1342543DE82EF95) + hashes[i:i + many]
        least = sliding_min(mix(hashed), length - seed + 1)
        windows = np.maximum(words - length + 1, 0)
        start = spread(base, windows)
        if not len(start):
            return none, none, none, none.astype(np.uint64), lambda i, j, n: []
        doc = np.repeat(np.arange(len(texts)), windows)
        keys = least[start]
        cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))))
        count = np.diff(np.append(cut, len(start)))
        first = start[cut]

        def packed(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> list[bytes]:
            a = first[i] + j
            return [b" ".join(text[x:y].split()) for x, y in zip(begin[a].tolist(), end[a + n + length - 2].tolist(), strict=True)]

        return doc[cut], first - base[doc[cut]], count, keys[cut], packed

    def same_windows(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of each string, and the class of each window: equal windows have equal classes."""
        parts = [s.split(b" ") for s in strings]
        sizes = np.array([len(p) for p in parts], np.int64)
        number: dict[bytes, int] = {}
        rank = np.array([number.setdefault(w, len(number)) for p in parts for w in p], np.int64)
        windows = sizes - self.length + 1
        have = 1
        while have < self.length:
            step = min(have, self.length - have)
            pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
            rank = np.unique(pair, return_inverse=True)[1]
            have += step
        begin = np.cumsum(sizes) - sizes
        return windows, rank[spread(begin, windows)]

    def keep(self, text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple:
        words = text.split()  # bytes split at exactly these separators
        if not len(starts):
            return len(words), 0, b" ".join(words).decode()
        change = np.zeros(len(words) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + counts - 1 + self.length, -1)
        covered = np.cumsum(change[:-1]) > 0
        kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
        return len(words), int(covered.sum()), b" ".join(kept).decode()


class Digests(Words):
    """As ``Words``, with the digest of what is kept in place of the text."""

    def __init__(self, length: int = LENGTH):
        super().__init__(length)
        del self.schema["kept"]
        self.schema["kept_sha256"] = pa.string()

    def keep(self, text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple:
        *numbers, kept = super().keep(text, starts, counts)
        return *numbers, hashlib.sha256(kept.encode()).hexdigest()


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, kind: type[Words] = Words) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: words covered by a window of ``length`` words whose sequence
    also starts in a document with a smaller ``doc_id`` are removed.  See the module text for edge cases."""
    return remove_repeats(docs, kind(length))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), kind=Digests)
