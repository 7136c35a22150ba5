"""Operators that judge one row at a time: quality, extraction, URLs, segmentations; and mixing and search."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import html_extraction, multi_index, quality_classifier, sentencepiece_sampling, source_mixing, url_filter
from plumbline.llm.html_extraction import main_text, minimum_cut

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MORE}/labels.parquet")
    model = quality_classifier.fit_quality(docs, labels)
    scored = quality_classifier.score_quality(docs.withColumn("score", F.lit("x")), model).join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    right = sum(r.quality == r.predicted for r in scored) / len(scored)
    recall = sum(r.predicted == 0 for r in scored if r.quality == 0) / max(sum(r.quality == 0 for r in scored), 1)
    assert right >= 0.95 and recall >= 0.8, (right, recall)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "plain words here"), (3, "x"), (4, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for model in (quality_classifier.fit_quality(docs, none), quality_classifier.fit([b"good words here " * 40] * 6, [b"%% ## !!" * 50] * 6, 0.9)):
        got = quality_classifier.score_quality(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert {r.score for r in got if not r.text} == {model.base}
    assert quality_classifier.score_quality(docs.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, dear reader, and this is a long sentence about them.</div><div class="ad">Buy this now!</div>
<main><article><h1>A &amp; B</h1><p><b>First paragraph of   the article,<br>
with a line break and an &eacute;.<p>Short.<ul><li>An item of the article's list</li><li>Another</li></ul><p>Last one with <a href="x">a link</a> inside it.</p></article>
<section id="comments"><p>I am a reader and I say that this article is very good indeed.</p></section></main>
<aside><p>Something about other things in the sidebar.</p></aside><form><label>Mail</label><input><button>Go</button></form>
<footer>&copy; Us</footer></body></html>"""


def test_extraction():
    assert main_text(PAGE).split("\n") == ["A & B", "First paragraph of the article, with a line break and an é.", "Short.",
                                           "An item of the article's list", "Another", "Last one with a link inside it."]
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<article><p>open text < 5 and > 3 &lt;b&gt; " + "word " * 30).startswith("open text < 5")
    assert main_text("<nav><a href=x>Menu only</a></nav>") == ""


def test_extraction_of_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 9), (1, "u", PAGE, 9)], "page_id long, url string, html string, text int")
    got = html_extraction.extract_main_text(pages).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(main_text(PAGE))), (2, 0), (1, len(main_text(PAGE)))]
    assert html_extraction.extract_main_text(pages.limit(0)).count() == 0


def test_minimum_cut_is_the_cheapest_labelling():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        a, b = rng.random(n).round(3) * 4, rng.random(n).round(3) * 4
        edges = [(i, j, float(rng.random().__round__(3))) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(b[i] if s else a[i] for i, s in enumerate(side)) + sum(w for i, j, w in edges if side[i] != side[j])

        best = min(map(cost, itertools.product([True, False], repeat=n)))
        assert cost(minimum_cut(a.tolist(), b.tolist(), edges)) == pytest.approx(best)


def test_url_rules(spark):
    urls = ["https://a.org/x", "http://org/", "https://m.example.org/es/1", "https://example.org/en/12?q", "https://Example.ORG/en/2#t", "https://shop.com/fr/",
            "https://shop.com/de/x", "https://x.net/en", "https://borg/", "https://a.org", "nothing", None, "", "ftp://h?x/y", "https://X.COM/FR/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "s") for i, u in enumerate(urls)], "page_id int, url string, score string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert [(got[i].host, got[i].path) for i in (2, 3, 4, 9, 10, 11, 12, 13, 14, 15)] == [
        ("m.example.org", "/es/1"), ("example.org", "/en/12"), ("example.org", "/en/2"), ("a.org", ""), ("", ""), ("", ""), ("", ""), ("h", ""),
        ("x.com", "/FR/"), ("b:", "//c/d")]
    rules = ["org/", "org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, None, None, None]
    assert [got[i].rule for i in range(16)] == rules
    assert [got[i].verdict for i in range(7)] == ["allow", "allow", "block", "block", "allow", "allow", "block"]
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def brute_url_scores(rows):
    """The same models in plain Python: raw scores of texts."""
    order = url_filter.ORDER
    texts = {}
    for text, settled in rows:
        texts[text] = max(filter(None, (texts.get(text), settled)), default=None)
    import hashlib

    def stretches(t):
        padded = "\u0002" * (order - 1) + t + "\u0003"
        return [padded[i:i + order] for i in range(len(padded) - order + 1)]

    counts = {k: Counter() for k in ("allow", "block")}
    for text, settled in texts.items():
        if settled and not hashlib.md5(text.encode()).hexdigest() < "3":
            for s in stretches(text):
                for n in range(1, order + 1):
                    counts[settled][s[order - n:]] += 1
    kinds, total = {k: Counter() for k in counts}, {k: Counter() for k in counts}
    for k, c in counts.items():
        for gram, n in c.items():
            kinds[k][gram[:-1], len(gram)] += 1
            total[k][gram[:-1], len(gram)] += n

    def chance(k, s):
        p = url_filter.FLOOR
        for n in range(1, order + 1):
            gram = s[order - n:]
            t, d = total[k][gram[:-1], n], kinds[k][gram[:-1], n]
            if t + d:
                p = (counts[k][gram] + d * p) / (t + d)
        return p

    return {t: sum(math.log(chance("allow", s)) - math.log(chance("block", s)) for s in stretches(t)) / (len(t) + 1) for t in texts}


def test_url_models_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF_MORE}/pages.parquet").select("page_id", "url")
    judged = url_filter.judge_urls(pages).collect()
    settled = {r: v for v, h, p in url_filter.RULES for r in [h + p]}
    raw = brute_url_scores([(r.host + r.path, settled.get(r.rule)) for r in judged])
    order = sorted({(raw[r.host + r.path], r.score) for r in judged})
    assert all(a[1] <= b[1] + 1e-9 for a, b in itertools.pairwise(order))  # calibration keeps the order of the scores
    free = [r for r in judged if r.rule is None]
    assert free and all((r.verdict == "allow") == (r.score >= 0.5) for r in free)
    ruled = [r for r in judged if r.rule]
    assert sum((r.score >= 0.5) == (r.verdict == "allow") for r in ruled) / len(ruled) > 0.9


def test_segmentations_are_sampled_without_replacement():
    own = sentencepiece_sampling.vocabulary_of(open(sentencepiece_sampling.MODEL, "rb").read())
    words = sentencepiece_sampling.words_of("the cat")
    lattices = sentencepiece_sampling.Lattices(own, words)
    n = 20_000
    rounds, threshold = sentencepiece_sampling.sample(lattices, np.tile(np.arange(len(words)), n), np.full(n, len(words)),
                                                      sentencepiece_sampling.row_keys(list(range(n))), 2)
    chance, first, either, weight = {}, Counter(), Counter(), Counter()
    seen = [set() for _ in range(n)]
    for number, r in enumerate(rounds):
        ids, many = lattices.spell(r.edges)
        sizes = np.add.reduceat(np.add.reduceat(many, r.path_begin), r.begin)
        for text, part, log in zip(r.texts, np.split(ids, np.cumsum(sizes)[:-1]), r.log, strict=True):
            key = tuple(part.tolist())
            assert key not in seen[text]
            seen[text].add(key)
            chance[key] = math.exp(log)
            first[key] += number == 0
            either[key] += 1
            weight[key] += 1 / -math.expm1(-math.exp(log - threshold[text]))
    assert sum(chance.values()) == pytest.approx(1, abs=1e-3)
    for key, p in sorted(chance.items(), key=lambda x: -x[1])[:3]:
        exact = p + sum(q * p / (1 - q) for other, q in chance.items() if other != key)
        assert first[key] / n == pytest.approx(p, abs=0.01)
        assert either[key] / n == pytest.approx(exact, abs=0.01)
        assert weight[key] / n == pytest.approx(1, abs=0.08)  # inclusion scores weigh the sample back to the whole


def test_all_segmentations_of_a_short_text_come_once():
    own = sentencepiece_sampling.vocabulary_of(open(sentencepiece_sampling.MODEL, "rb").read())
    lattices = sentencepiece_sampling.Lattices(own, sentencepiece_sampling.words_of("of it"))
    rounds, threshold = sentencepiece_sampling.sample(lattices, np.array([0, 1]), np.array([2]), sentencepiece_sampling.row_keys([4]), 500)
    assert len({tuple(r.edges.tolist()) for r in rounds}) == len(rounds) < 500
    assert sum(math.exp(r.log[0]) for r in rounds) == pytest.approx(1) and threshold[0] == -math.inf
    assert all(a.value[0] >= b.value[0] for a, b in itertools.pairwise(rounds))


def test_encoding_is_the_tokenizers_and_round_trips(spark):
    texts = ["", None, " ", "  a  b ", "\n\nx\ty ", "日本語 emoji 😀 \u0000 z", "   ", "x" * 3000, "a▁b", "The quick brown fox."]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "end", 7)], "doc_id long, text string, ids int")
    rows = sentencepiece_sampling.encode_and_sample(docs).collect()
    own = sentencepiece_sampling.vocabulary_of(open(sentencepiece_sampling.MODEL, "rb").read())
    for r in rows[:10]:
        text = texts[r.doc_id] or ""
        assert r.ids == own.tool.encode(text)
        assert r.decodes == ("▁" not in text)
        for ids in [r.ids, *r.samples] if r.decodes and text else []:
            assert own.decode(np.array(ids)) == text
    assert rows[10][1:] == rows[3][1:] and len(rows) == 12
    assert rows[0].samples == [[]] and rows[0].inclusions == [1.0]
    assert sentencepiece_sampling.encode_and_sample(docs.limit(0)).count() == 0


def test_registered_segmentations_are_whole(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = sentencepiece_sampling.vocabulary_of(open(sentencepiece_sampling.MODEL, "rb").read())
    rows = sentencepiece_sampling.op8_sentencepiece(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.ids == own.tool.encode(text[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, np.int32).tobytes()).hexdigest()
        assert len({tuple(s) for s in r.samples}) == len(r.samples) == len(r.log_chances) == len(r.inclusions) == r.n_sampled
        assert all(own.decode(np.array(s)) == text[r.doc_id] for s in r.samples)


def test_mixing_targets_and_flow():
    assert source_mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert source_mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    # Two sources share a pattern; the cheap first round of all patterns is used before a second one.
    given = source_mixing.route([100, 100, 50], [[0], [1], [0, 1]], [120, 110])
    assert sum(given) == 230 and given == [min(g, 100) if i < 2 else g for i, g in enumerate(given)] and given[2] <= 50
    assert source_mixing.route([10], [[0]], [25]) == [25]
    assert source_mixing.route([10], [[0]], [40]) == [30]


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a"] if i % 3 else ["b", "a"] if i % 2 else ["b"]) for i in range(300)]
    rows += [(400, None, None), (401, "x y", []), (402, "", ["a"]), (402, "", ["a"]), (None, "q r s", ["b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>").withColumn("size", F.lit("clash"))
    mixed = source_mixing.mix_sources(docs, F.col("sources"))
    got = mixed.rows.collect()
    table = {r.name: r.target for r in mixed.sources.collect()}
    assert len(got) == len(rows) and set(table) == {"a", "b", None}
    assert all(r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(table.values()), abs=15)
    again = source_mixing.mix_sources(docs.repartition(7), F.col("sources")).rows.collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert source_mixing.mix_sources(docs.limit(0), F.col("sources")).rows.count() == 0


def test_mixing_many_sources_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "MAX_PATTERNS", 10)
    monkeypatch.setattr(source_mixing, "BROADCAST_ROWS", 10)
    names = ("last", "rest", "rounds", "before", "row", "order", "id", "prefix", "extra", "tokens")
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 11 AS INT)) AS text", "concat('s', id % 500) AS source",
                                        *[f"id AS `{n}`" for n in names if n != "id"]).withColumn("id", F.col("doc_id"))
    mixed = source_mixing.mix_sources(docs, F.array("source"))
    got, table = mixed.rows.collect(), mixed.sources.orderBy("name").collect()
    assert len(got) == 3000 and all(r[n] == r.doc_id for r in got for n in names)
    assert [r.target for r in table] == pytest.approx(source_mixing.targets([r.source_size for r in table], [(5, 2, 1)[i % 3] for i in range(500)]))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.name] - r.target) <= 5.5 for r in table)


def test_search_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 12)).astype(np.float32)
    x[2990:] = x[2980]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 12), (5040, [float("nan")] * 12), (5060, [1.0]), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = multi_index.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20).collect()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    for query, found in by.items():
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - exact[query, r.vec_id]) < 1e-9 for r in found)
        best = sorted(range(3000), key=lambda i: (-exact[query, i], i))[:20]
        hits += len({r.vec_id for r in found} & set(best))
    assert hits / (20 * len(by)) >= 0.9
    few = multi_index.nearest_neighbours(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]
    assert multi_index.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = vectors.orderBy("vec_id").toArrow()
    x = np.array(table["embedding"].to_pylist(), np.float64)
    ids = np.array(table["vec_id"])
    got = multi_index.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, 20).collect()
    hits = Counter()
    for r in got:
        hits[r.query_id, r.vec_id] = 1
    queries = [i for i in ids.tolist() if i % 20 == 0]
    found = 0
    for q in queries:
        row = x @ x[ids.tolist().index(q)]
        best = [i for i in ids[np.lexsort((ids, -row))].tolist() if i != q][:20]
        found += sum(hits[q, b] for b in best)
    assert found / (20 * len(queries)) >= 0.9


def test_search_does_not_depend_on_regions_and_blocks(spark, monkeypatch):
    """A third of the vectors alike, many small regions, several blocks of queries in each."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    asked = F.col("vec_id") % 5 == 0
    whole = sorted(map(tuple, multi_index.nearest_neighbours(df, asked, 10).collect()))
    monkeypatch.setattr(multi_index, "REGION_BYTES", 8 * 8 * 40)
    monkeypatch.setattr(multi_index, "QUERIES", 16)
    assert sorted(map(tuple, multi_index.nearest_neighbours(df, asked, 10).collect())) == whole


def test_registered_sql(spark):
    from check_oracles import compare, duck

    for name in ("op4_embedding_dedup", "op9_source_mixing", "op12_spelling_variants", "op13_merkle_manifest"):
        assert compare(spark, duck(SF), SF, name) == ""


def test_lattices_share_ends_and_words_are_built_once():
    own = sentencepiece_sampling.vocabulary_of(open(sentencepiece_sampling.MODEL, "rb").read())
    words = sentencepiece_sampling.words_of("spelling smelling telling spilling")
    together = sentencepiece_sampling.Lattices(own, words)
    assert len(together.rest) < 0.7 * sum(map(len, words))  # a state each character before
    for number, word in enumerate(words):
        alone = sentencepiece_sampling.Lattices(own, [word])
        state, same = int(together.start[number]), int(alone.start[0])
        while state >= 0:
            edges, others = (slice(x.first[at], x.first[at + 1]) for x, at in ((together, state), (alone, same)))
            assert together.piece[edges].tolist() == alone.piece[others].tolist()
            assert together.chance[edges] == pytest.approx(alone.chance[others], abs=1e-12)
            state, same = int(together.rest[state]), int(alone.rest[same])
        assert same < 0
    lexicon = sentencepiece_sampling.Lexicon(own)
    split, counts = sentencepiece_sampling.split_words([(sentencepiece_sampling.SPACE + t).encode() for t in ("a▁b", "a", "▁")] + [b""])
    assert split.to_pylist() == [" a", " b", " a", "  "] and counts.tolist() == [2, 1, 1, 0]
    first = lexicon.numbers(split)
    made = len(lexicon.lattices.rest)
    assert lexicon.numbers(split).tolist() == first.tolist() == [0, 1, 0, 2] and len(lexicon.lattices.rest) == made
