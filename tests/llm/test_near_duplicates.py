"""Order MinHash, sign hashing and components against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import _components, embedding_dedup, minhash_dedup
from plumbline.llm._components import connected_components
from plumbline.llm.minhash_dedup import aligned, shingles


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def labelled(text):
    words, seen, out = (text or "").split(), Counter(), []
    for i in range(max(len(words) - 4, min(len(words), 1))):
        key = tuple(words[i:i + 5])
        seen[key] += 1
        out.append((key, seen[key]))
    return out


def brute_classes(rows):
    texts = [(d, labelled(t)) for d, t in rows]
    edges = []
    for i, (a, x) in enumerate(texts):
        for b, y in texts[:i]:
            if x and y:
                m = longest_common(x, y)
                if m >= 0.8 * (len(x) + len(y) - m) - 1e-9:
                    edges.append((a, b))
    return components([d for d, _ in rows], edges)


def near_corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, number = [], 0
    common = rng.choices(vocabulary, k=40)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        if rng.random() < 0.5:
            base = base[:20] + common + base[20:]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2 and len(words) > 20:
                words = words[len(words) // 2:] + words[:len(words) // 2]
            rows.append((number := number + 1, " ".join(words)))
    chain = rng.choices(vocabulary, k=100)  # neighbours alike, ends apart
    for i in range(6):
        rows.append((number := number + 1, " ".join(chain[i * 6:i * 6 + 70])))
    rows += [(900, "line one two three four " * 30), (901, "line one two three four " * 33), (902, ""), (903, None), (904, "   "), (905, "short"), (906, "short")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "GROUP", 2)
    rows = near_corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_banded_alignment_equals_the_full_one():
    rng = random.Random(5)
    seen = Counter()
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 2)] = [rng.choice("xyz")] * rng.randint(0, 2)
            b = b or ["z"]
        x, y = (shingles([" ".join(t).encode()])[0] for t in (a, b))
        m = longest_common(x.tolist(), y.tolist())
        want = m >= 0.8 * (len(x) + len(y) - m) - 1e-9
        assert aligned(x, y, 0.8) == want
        seen[want] += 1
    assert min(seen.values()) > 30


def test_short_texts_lose_no_link(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        size = rng.choice([8, 8, 9, 12, 13, 18, 30, 54])
        words = [f"s{i}x{j}" for j in range(size + 1)]
        rows += [(2 * i, " ".join(words[:size])), (2 * i + 1, " ".join(words))]  # one word longer
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n - n % 2 for n, _ in rows}


def test_shared_shingles_are_counted_alike_by_product_and_by_pairs(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))).encode() for _ in range(40)] + [b"only here and nowhere else"]
    hashes, counts = shingles(texts)
    parts = [set(p.tolist()) for p in np.split(hashes, np.cumsum(counts)[:-1])]
    for frequent in (0, 8, 1 << 20):
        monkeypatch.setattr(minhash_dedup, "FREQUENT", frequent)
        got = minhash_dedup.overlaps(hashes, counts)
        assert all(got[i, j] == len(parts[i] & parts[j]) for i in range(41) for j in range(41) if i != j)


def test_different_texts_under_one_id_are_both_compared(spark):
    one, two = ([f"{k}{i}" for i in range(60)] for k in "ab")
    rows = [(1, one), (5, two), (5, one[:-1]), (3, two[1:]), (9, ["other"] + two[2:]), (7, [f"c{i}" for i in range(60)])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 5: 1, 3: 1, 9: 1, 7: 7}


def test_repeated_ids_null_ids_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text), (2, text), (2, "something else that is here alone"), (None, text), (3, "something else that is here alone"), (2, text)]
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 1, False)]
    null = [r for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is None]
    assert [tuple(r) for r in null] == [(None, None, True)]
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (2000, 7), (2000, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: c for n, c in components(nodes, [e for e in edges if e[0] != e[1]]).items()}


@pytest.fixture
def many_partitions(spark):
    """40 shuffle partitions that nothing puts together again, and no broadcasts: how a step of a large corpus is planned."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_few_edges_need_few_tasks(spark, monkeypatch, many_partitions):
    """``pipeline`` on check_h: a step of the components left files once a shuffle partition, however few edges there were."""
    made = []
    cut = _components.cut_lineage
    monkeypatch.setattr(_components, "cut_lineage", lambda df: made.append(cut(df)) or made[-1])
    edges = [(i, i + 1) for i in range(0, 60)] + [(i, 100) for i in range(101, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert len(made) > 4 and max(df.rdd.getNumPartitions() for df in made[1:]) <= 2 * spark.sparkContext.defaultParallelism
    made.clear()
    monkeypatch.setattr(_components, "EDGES", 4)  # many edges: as many tasks as they need
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert max(df.rdd.getNumPartitions() for df in made[1:]) == 40


def test_texts_are_dealt_out_once_before_they_meet(spark, monkeypatch, many_partitions, capsys):
    """``pipeline`` on check_h: each text was dealt out by document, then by its number, then to its group."""
    plans = []
    cut = minhash_dedup.cut_lineage

    def noted(df):
        df.explain("formatted")
        plans.append(capsys.readouterr().out)
        return cut(df)

    monkeypatch.setattr(minhash_dedup, "cut_lineage", noted)
    rows = near_corpus(1)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    dealt = [len(re.findall(r"Exchange\nInput \[\d+\]: \[[^\]]*\btext#", plan)) for plan in plans if "FlatMapGroupsInArrow" in plan]
    assert dealt == [2, 2]  # by document, to the group


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows, number = [], 0
    for _ in range(25):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((number := number + 1, (base + rng.standard_normal(16) * rng.choice([0.03, 0.1, 0.2])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    same = rng.standard_normal(16).astype(np.float32).tolist()
    rows += [(1000 + i, same, 1) for i in range(60)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, same[:3] + [None], 1), (2004, same, None),
           (2005, same[:8], 1), (2006, same[:8], 1), (2007, [], 1), (2008, [float("inf")] * 16, 1)]
    links = defaultdict(set)
    alike = rows + [(2005, same[:8], 1), (2006, same[:8], 1)]
    for a, x, la in alike:
        for b, y, lb in alike:
            if a < b and la == lb and len(x) == len(y):
                p, q = np.array(x, np.float64), np.array(y, np.float64)
                if p @ q / math.sqrt((p @ p) * (q @ q)) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    every = rows + odd + [rows[0]]
    df = spark.createDataFrame([(*r, "k") for r in every], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    roots = components({r[0] for r in every}, [(a, b) for a in links for b in links[a]])
    assert got == {n: (len(links[n]), c, n == c) for n, c in roots.items()}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "labels"), [("string", ("a", "b")), ("double", (1.2, 1.7))])
def test_labels_of_any_type_are_compared_as_they_are(spark, kind, labels):
    rows = [(1, [1.0, 2.0], labels[0]), (2, [1.0, 2.0], labels[1]), (3, [2.0, 4.0], labels[0]), (4, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (4, 0, 4, True)]


def test_sketches_pick_the_least_shingles_without_a_step_a_text(monkeypatch):
    """the same keys as text by text, with one sort a sketch; only texts with too few low values are read alone."""
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % w for w in rng.integers(0, 40 if i % 3 else 4_000, n)) for i, n in enumerate([*rng.integers(0, 600, 300), 4, 8, 9, 0, 30_000])]
    hashes, counts = minhash_dedup.shingles(texts)
    alone, part = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda *a, **k: alone.append(1) or part(*a, **k))
    got = minhash_dedup.sketches(hashes, counts)
    assert len(alone) < len(texts)
    monkeypatch.setattr(minhash_dedup, "EXPECTED", 3)  # most texts have too few values below their bound
    assert (minhash_dedup.sketches(hashes, counts) == got).all() and len(alone) > len(texts)
    for d, (a, n) in enumerate(zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True)):
        for s, seed in enumerate(minhash_dedup.SEEDS):
            low = np.sort(np.argsort(minhash_dedup.mix(hashes[a:a + n] * seed))[:minhash_dedup.TUPLE])
            low = np.concatenate([low, np.full(minhash_dedup.TUPLE - len(low), n - 1)]) if n else low
            value = np.full(1, np.uint64(s + 1))
            for i in low.tolist():
                value = minhash_dedup.mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[a + i])
            assert got[d, s] == (value[0] if n else 0)


def test_shingles_that_repeat_are_numbered_in_text_order():
    texts = [b"a b c d e " * 4, b"a b c d e " * 3, b"x"]
    hashes, counts = minhash_dedup.shingles(texts)
    assert counts.tolist() == [16, 11, 1] and len(set(hashes[:16].tolist())) == 16
    assert (hashes[:11] == hashes[16:27]).all()  # the first, second, ... of equal shingles are the same in both texts
