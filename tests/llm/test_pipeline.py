"""The corpus pipeline, stage by stage, against plain Python on the smallest tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm.sentencepiece_sampling import MODEL, vocabulary_of
from plumbline.llm.source_mixing import targets
from plumbline.session import scratch_path
from test_near_duplicates import components, labelled, longest_common

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of ``documents`` and of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "pieces"]
    for rows in stages[1:5]:
        assert all(list(r.asDict()) == corpus_pipeline.COLUMNS and r.n_chars == len(r.text) for r in rows)


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    clean = [r.doc_id for r in stages[0] if labels.get(r.doc_id) == 1]
    # 52 labelled rows to learn from here; on sf0.1 the model keeps over 99 % of the clean held-out documents
    assert kept <= {r.doc_id for r in stages[0]} and sum(d in kept for d in clean) >= 0.9 * len(clean)


def test_one_document_of_each_class_stays(stages):
    texts = [(r.doc_id, labelled(r.text)) for r in stages[1]]
    edges = []
    for i, (a, x) in enumerate(texts):
        for b, y in texts[:i]:
            need = 0.8 * (len(x) + len(y)) / 1.8 - 1e-9
            if x and y and min(len(x), len(y)) >= need and len(set(x) & set(y)) >= need and longest_common(x, y) >= need:
                edges.append((a, b))
    roots = components([d for d, _ in texts], edges)
    assert sorted(r.doc_id for r in stages[2]) == sorted(set(roots.values()))


def test_repeated_passages_go(stages):
    least = {}
    rows = sorted((r.doc_id, r.text.encode()) for r in stages[2])
    for doc, text in rows:
        for i in range(len(text) - 49):
            least.setdefault(text[i:i + 50], doc)
    want = {}
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - 49):
            if least[text[i:i + 50]] < doc:
                gone[i:i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or kept.strip(" "):
            want[doc] = kept
    assert {r.doc_id: r.text for r in stages[3]} == want


def test_sources_come_near_their_targets(stages):
    before, after, largest = Counter(), Counter(), Counter()
    for r in stages[3]:
        before[r.source] += len(r.text.split())
        largest[r.source] = max(largest[r.source], len(r.text.split()))
    for r in stages[4]:
        after[r.source] += len(r.text.split())
    names = sorted(before)
    goal = targets([before[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert all(abs(after[n] - g) <= largest[n] / 2 + 1 for n, g in zip(names, goal, strict=True))
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3


def test_pieces_of_every_document_taken(stages):
    with open(MODEL, "rb") as file:
        tool = vocabulary_of(file.read()).tool
    text = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    assert all(r.n_ids == len(tool.encode(text[r.doc_id])) and r.decodes for r in stages[5])


def test_pieces_come_as_lists(stages):
    """The result itself holds the ids and the sampled segmentations, not only their digests."""
    with open(MODEL, "rb") as file:
        own = vocabulary_of(file.read())
    text = {r.doc_id: r.text for r in stages[4]}
    for r in stages[5]:
        assert r.ids == own.tool.encode(text[r.doc_id]) and len(r.ids) == r.n_ids
        assert [len(s) for s in r.samples] == r.sample_sizes and len({tuple(s) for s in r.samples}) == r.n_sampled
        assert len(r.log_chances) == len(r.inclusions) == len(r.samples)
        assert all(own.decode(np.array(s)) == text[r.doc_id] for s in r.samples)
