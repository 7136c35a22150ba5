"""Toxicity, spelling variants and the Merkle manifest against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle_manifest, spelling_variants, toxicity

SF_MORE = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """Root, and of each node the siblings before and after it on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k - k % fanout
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + fanout])))
            at[i] = k // fanout
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_manifest(rows, fanout):
    """Rows of doc_id, source, lang, n_chars, text -> the contract's columns."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(told, r))
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [tree([leaf(r) for r in g], fanout) for g in groups]
    root, above = tree([t[0] for t in trees], fanout) if trees else (None, [])
    out = []
    for group, (subroot, paths), upper in zip(groups, trees, above, strict=True):
        for r, path in zip(group, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf((*r[:4], low(r[4]))) if hit else leaf(r)
            for before, after in path + upper:
                folded = H(before, folded, after)
            out.append((r[0], leaf(r), subroot, root, H(*itertools.chain(*(path + upper))), folded, folded == root))
    return out


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 1), (2, 2), (16, 2)])
def test_manifest_equals_brute_force(spark, fanout, levels):
    rng = random.Random(fanout * 10 + levels)
    rows = [(1, "one", "en", 3, "ABC"), (None, None, None, None, None), (None, None, "x", 1, ""), (7, "one", "en", 3, "É A"), (7, "one", "en", 3, "other")]
    sizes = {"big": 41, "Mid": 17, "é": 8, "": 3, "z": 1, "y": 2, None: 5}
    for i, (source, n) in enumerate(sizes.items()):
        rows += [(1000 * i + k, source, rng.choice(["en", None]), k, f"Text {k} " * rng.randint(0, 3)) for k in range(n)]
    rows += [(5, "twice", "en", 1, "Same")] * 4
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree long, pos long, root long")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(hit, F.translate("text", spelling_variants.UPPER, spelling_variants.LOWER))
    got = merkle_manifest.manifest(docs, changed, fanout, levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in got.select(*names).collect()]
    wanted = brute_manifest(rows, fanout)
    assert Counter(found) == Counter(wanted)
    assert {r[6] for r in found} == {True, False}
    # siblings themselves are returned, and lead to the root
    for r in got.select("leaf", "root", "lefts", "rights", "folded_root", "verified").collect():
        node = r.leaf
        for before, after in zip(r.lefts, r.rights, strict=True):
            node = H(before, node, after)
        assert node == r.root and r.verified == (r.folded_root == r.root)


def test_manifest_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle_manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle_manifest.manifest(spark.createDataFrame([(3, "s", None, None, "long " * 100_000)], schema)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].lefts == [] and one[0].proof_sha256 == H()


# ---------------------------------------------------------------- spelling variants

def brute_variants(words):
    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words = {}
    for letters in ("ab", "abé", "lmnopÿ"):
        for _ in range(150):
            words["".join(rng.choice(letters) for _ in range(rng.randint(5, 7)))] = 2 ** rng.randint(2, 9)
    for i in range(12):  # a chain of forms
        words["q" * 5 + "r" * i] = 3 * 2 ** i
    frame = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, form long")
    got = [tuple(r) for r in spelling_variants.spelling_variants(frame).collect()]
    assert Counter(got) == Counter(brute_variants(words))


def test_word_counts_equal_brute_force(spark):
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("aBcÉ×") for _ in range(rng.randint(4, 6)))
    vocabulary = [make() for _ in range(40)]
    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(rng.choice(vocabulary) for _ in range(60))) for i in range(120)]
    rows += [(None, "nullid nullid nullid"), (5, None), (6, ""), (7, "9 _ 9"), (8, "long" * 30_000), (8, "long" * 30_000), (9, "long" * 30_000)]
    counts, altered = Counter(), 0
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run, altered = run[:h % len(run)] + run[h % len(run) + 1:], altered + 1
            if len(run) >= 5:
                counts[run] += 1
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    got = {r.word: r.n for r in spelling_variants.word_counts(docs).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 3} and altered
    empty = docs.limit(0)
    assert spelling_variants.spelling_variants(spelling_variants.word_counts(empty)).count() == 0


def test_a_range_holds_a_letter_once(spark):
    """However common words are, a prefix range has a row a letter at most."""
    words = {a + "orms" + b: 10 for a in "abcdefgh" for b in "xyz"} | {"orms" + b: 7 for b in "xyz"}
    ranges = spelling_variants.rotations(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert ranges.groupBy("range", "edit").count().filter("count > 1").isEmpty()
    assert ranges.count() == sum(2 * len(w) + 1 for w in words)


# ---------------------------------------------------------------- toxicity

def labelled(n, seed):
    rng = random.Random(seed)
    syllables = ["ti", "on", "re", "ha", "st", "en", "ou", "ly", "wh", "er"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(20, 300))], int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) * toxic):
            words[rng.randrange(len(words))] = rng.choice(["Blockhead", "vermin!", "dimwit", "SCOUNDREL"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert sum(y == p for y, p in held) / len(held) >= 0.98
    assert sum(p for y, p in held if y) / sum(y for y, _ in held) >= 0.9
    # held-out labels are not learnt from: turning them round changes nothing
    turned = spark.createDataFrame([(i, 1 - y if got[i].held_out else y) for i, _, y in rows], "doc_id long, toxic int")
    again = toxicity.fit_toxicity(docs, turned)
    assert again.toxic == model.toxic and list(again.theta) == list(model.theta)


def test_toxicity_on_the_given_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_MORE}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    held = toxicity.score_toxicity(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter("held_out").collect()
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    # a few dozen toxic texts to learn from: those in languages with a text or two are not told
    assert sum(r.predicted for r in held if r.toxic) >= 0.65 * sum(r.toxic for r in held)


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "you vermin"), (3, "x"), (4, "word " * 50_000), (5, "w" * 100_000), (6, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for model in (toxicity.fit_toxicity(docs, none), toxicity.fit([b"you vermin " * 9] * 6, [b"you dear " * 9] * 6, 0.3)):
        got = toxicity.score_toxicity(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert len({r.score for r in got if not (r.text or "").strip()}) == 1 and not [r for r in got if r.doc_id is None and r.held_out]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    pieces = toxicity.windows(b"a " + b"xy" * 90 + b" b")
    assert max(map(len, pieces)) <= toxicity.PIECE and pieces[0] == b"a" and pieces[-1] == b"b"


def test_gains_do_not_depend_on_what_is_kept():
    model = toxicity.ToxicityModel(b"the quiet day goes on and on " * 9, b" vermin blockhead ", 0.1)
    texts = [t.encode() for _, t, _ in labelled(40, 2)]
    first = model.gains(texts)
    toxicity._gains.clear()
    assert first == [g for t in texts for g in model.gains([t])]
