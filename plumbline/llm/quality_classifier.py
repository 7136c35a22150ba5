"""Quality of texts by compression: zstandard dictionaries built from good and from bad labelled text.

A text like the good ones compresses better with their dictionary than with the bad ones', and the other way
round.  The difference of the two sizes over their sum, a number between -1 and 1, is turned into a
probability by a logistic curve fitted on labelled texts that the dictionaries did not see.  Texts are
compressed whole, in blocks of ``BLOCK`` bytes, so that a long text's own repetitions do not drown the dictionary.

The model is fitted on at most ``SAMPLE`` labelled rows of each class (in the order of a hash of ``doc_id``), half for
the dictionaries and half for the curve; scoring is one narrow pass over all rows.

Defined cases: null and blank-free empty texts get the share of good labels; without labels of both classes every text
gets that share (0.5 without any label); repeated rows are scored alike; a null ``doc_id`` is not held out; rows with
null labels or texts are not learnt from; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm._repeats import _texts

SAMPLE = 2_000
BLOCK = 4096
DICTIONARY = 64 << 10
LEVEL = 3


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """Content of a dictionary; too few texts to train on are a dictionary themselves."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


class CompressionModel:
    """Two dictionaries and the logistic curve over their normalised difference."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", base: float = 0.5, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.base, self.slope, self.offset = good, bad, base, slope, offset

    def differences(self, texts: list[bytes]) -> np.ndarray:
        tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._prepared(d), write_content_size=False, write_dict_id=False)
                 for d in (self.good, self.bad)]
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if text:
                good, bad = (sum(len(tool.compress(b)) for b in blocks(text)) for tool in tools)
                out[i] = (bad - good) / (bad + good)
        return out

    @staticmethod
    def _prepared(content: bytes) -> zstandard.ZstdCompressionDict:
        made = zstandard.ZstdCompressionDict(content)
        made.precompute_compress(level=LEVEL)
        return made

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not (self.good and self.bad):
            return np.full(len(texts), self.base)
        curve = 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -40, 40)))
        return np.where([bool(t) for t in texts], curve, self.base)


def fit(good: list[bytes], bad: list[bytes], base: float) -> CompressionModel:
    """Even rows make the dictionaries, odd rows the curve."""
    if not (good and bad):
        return CompressionModel(base=base)
    model = CompressionModel(dictionary(good[::2]), dictionary(bad[::2]), base)
    seen_good, seen_bad = good[1::2] or good, bad[1::2] or bad
    x = model.differences(seen_good + seen_bad)
    y = np.repeat([1.0, 0.0], [len(seen_good), len(seen_bad)])
    # The classes were sampled apart; weights bring them back to their shares.
    w = np.where(y == 1, base / len(seen_good), (1 - base) / len(seen_bad)) * len(y)
    scale = max(float(np.abs(x).max()), 1e-9)
    design = np.column_stack([x / scale, np.ones(len(x))])
    theta = np.zeros(2)
    for _ in range(50):  # Newton steps with a slight pull to zero, for classes that separate fully
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        pull = np.array([1e-2, 1e-6])
        gradient = design.T @ (w * (p - y)) + pull * theta
        curvature = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(pull)
        theta = theta - np.clip(np.linalg.solve(curvature, gradient), -5, 5)
    model.slope, model.offset = float(theta[0] / scale), float(theta[1])
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """A model from the labelled rows that are not held out; at most ``SAMPLE`` of a class come to the driver."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    base = counts.get(1, 0) / total if total else 0.5
    texts = docs.filter("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    drawn = {}
    for quality in (0, 1):
        # Ids are drawn first, so that only the sample's texts are sorted and sent.
        ids = known.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id")
        rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        drawn[quality] = [r.text.encode() for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    return fit(drawn[1], drawn[0], base)


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """All columns of ``docs`` but ``held_out``, ``score`` and ``predicted``, which are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_texts(batch["text"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    plain = docs.drop("held_out", "score", "predicted")
    scored = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("held_out", held_out()).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")
