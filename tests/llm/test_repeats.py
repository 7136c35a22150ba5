"""Substring dedup on bytes and words against brute force."""

import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import _repeats, substring_dedup, suffix_dedup


def brute(rows, length, split, join):
    parts = [(doc, split(text or "")) for doc, text in rows]
    least = {}
    for doc, units in parts:
        for i in range(len(units) - length + 1):
            key = tuple(units[i:i + length])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, units in parts:
        gone = [False] * len(units)
        for i in range(len(units) - length + 1):
            if least[tuple(units[i:i + length])] < doc:
                gone[i:i + length] = [True] * length
        kept = [u for u, g in zip(units, gone, strict=True) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(units), sum(gone), spans, hashlib.sha256(join(kept)).hexdigest()))
    return sorted(out)


def corpus(seed, alphabet, n_docs=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))))
        rows.append((i * 7 % 41, rng.choice([" ", "\n", "\t ", "  "]).join(parts)))
    rows += [(100, ""), (101, None), (102, "a" * 300), (103, "a" * 300 + "b"), (104, "ab" * 200), (105, shared[0]), (106, shared[0]),
             (-5, shared[1]), (107, "\0" * 80), (108, "x" + "\0" * 80), (109, "ünïcödé " * 30), (110, "ünïcödé " * 30)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, False), (2, False), (3, True)])
@pytest.mark.parametrize("name", ["bytes", "words"])
def test_equals_brute_force(spark, monkeypatch, name, seed, hot):
    if hot:  # nearly every minimiser counts as frequent
        monkeypatch.setattr(_repeats, "HOT_LEAST", 2)
        monkeypatch.setattr(_repeats, "HOT_SHARE", 1_000_000)
    rows = corpus(seed, "abcdü")
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string").repartition(5)
    if name == "bytes":
        got = suffix_dedup.remove_repeated_bytes(docs, kind=suffix_dedup.Digests)
        want = brute(rows, 50, lambda t: list(t.encode()), bytes)
        assert sorted(tuple(r) for r in got.collect()) == want
    else:
        got = substring_dedup.remove_repeated_words(docs, kind=substring_dedup.Digests)
        want = brute(rows, 13, lambda t: t.encode().split(), b" ".join)
        assert sorted(tuple(r) for r in got.collect()) == [(d, n, g, h) for d, n, g, _, h in want]


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = "other " * 3 + text
    docs = spark.createDataFrame([(5, text), (5, text), (5, other), (None, text), (9, text)], "doc_id long, text string")
    got = substring_dedup.remove_repeated_words(docs).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 40, 0), (5, 40, 0), (5, 43, 0), (None, 40, 0), (9, 40, 40)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_bytes int")
    assert suffix_dedup.remove_repeated_bytes(docs).count() == 0
    assert substring_dedup.remove_repeated_words(docs).count() == 0


def test_interval_expansion_finds_the_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = rng.integers(1, 4, 200).astype(np.uint16)
        text[rng.integers(0, 200, 6)] = 0
        text[-1] = 0
        order = suffix_dedup.suffix_order(text, 8)
        first = suffix_dedup.expand_intervals(order, text, 8)
        classes = defaultdict(set)
        for number, at in zip(np.cumsum(first), order, strict=True):
            window = tuple(text[at:at + 8])
            if len(window) == 8 and 0 not in window:
                classes[number].add(window)
        assert all(len(c) == 1 for c in classes.values())
        assert len({w for c in classes.values() for w in c}) == len(classes)


def test_readable_text_stays_whole(spark):
    text = "é" * 60
    docs = spark.createDataFrame([(1, text), (2, "a" + text[:40])], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeated_bytes(docs, kind=suffix_dedup.Readable).collect()}
    assert kept == {1: text, 2: "a"}


def test_steps_over_texts_hold_little_at_once():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 2_000).astype(np.uint8).tobytes() for _ in range(2_000)]
    unit, seen = suffix_dedup.Digests(), 0
    tracemalloc.start()
    for a, b in _repeats.chunks(texts):
        seen += int(unit.runs(texts[a:b])[2].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts) * 1_951
    assert peak < 40 << 20  # arrays of 2 MB of text at a time take several times as much


@pytest.mark.parametrize("many", [1, 3, 200])
def test_same_windows_have_the_same_class(many):
    rng = random.Random(many)
    parts = [bytes(rng.choice((0, 97, 98, 255)) for _ in range(rng.randint(8, 30))) for _ in range(8)] + [b"\0" * 12, b"\xff" * 9]
    strings = list(dict.fromkeys(b"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(many)))
    windows, classes = suffix_dedup.Bytes(8).same_windows(strings)
    every = [s[i:i + 8] for s in strings for i in range(len(s) - 7)]
    assert windows.tolist() == [len(s) - 7 for s in strings] and len(classes) == len(every)
    assert len(set(zip(every, classes.tolist(), strict=True))) == len(set(every)) == len(set(classes.tolist()))


@pytest.mark.parametrize("unit", [suffix_dedup.Bytes(), substring_dedup.Words()])
def test_strings_alone_under_their_minimiser_are_not_compared(monkeypatch, unit):
    """runs that only whole copies share meet no comparison; parts of a run do."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)).encode()
    seen = []
    same = type(unit).same_windows
    monkeypatch.setattr(type(unit), "same_windows", lambda self, strings: seen.append(len(strings)) or same(self, strings))
    _, _, count, _, cut = unit.runs([text])
    every = cut(np.arange(len(count)), np.zeros(len(count), np.int64), count)
    size, shared = _repeats.rivals(unit, every)
    assert size.tolist() == count.tolist() and not shared.any()
    long = int(np.argmax(count))
    part = cut(np.array([long]), np.array([1]), count[[long]] - 1)
    size, shared = _repeats.rivals(unit, every + part)
    assert np.flatnonzero(shared).tolist() == [long, len(every)] and size[-1] == count[long] - 1

    def rows(doc, strings):
        meta = np.array([(doc, 0, 10 * i, len(s)) for i, s in enumerate(strings)], np.int64)
        return {"bucket": 0, "meta": _repeats.squeeze(meta.T.reshape(-1)), "strings": _repeats.zstandard.compress(b"".join(strings))}

    def judge(*groups):
        out = _repeats._judge(unit, 1, 1)(_repeats.pa.Table.from_pylist(list(groups)))
        found = b"".join(_repeats.zstandard.decompress(x) for x in out["spans"].to_pylist())
        return sorted(map(tuple, np.frombuffer(found, np.int64).reshape(-1, 4).tolist()))

    assert judge(rows(1, every), rows(2, every)) == [(2, 0, 10 * i, n) for i, n in enumerate(count.tolist())] and not seen
    assert judge(rows(1, every), rows(2, part)) == [(2, 0, 0, count[long] - 1)] and seen == [2]


def test_few_seeds_agree_by_chance():
    """texts of few words share few minimisers unless they share windows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(20_000)).encode() for _ in range(2)]
    unit = suffix_dedup.Bytes()
    doc, _, _, keys, _ = unit.runs(texts)
    assert len(np.intersect1d(keys[doc == 0], keys[doc == 1])) < len(keys) / 1_000
