"""Toxicity by compression distance: windows of a text against zstandard dictionaries of toxic and of ordinary text.

A window is one word in lower case with a space on either side (longer ones in overlapping pieces).  Its *gain* is how many bytes shorter it
becomes with the toxic dictionary than with the ordinary one.  The ordinary dictionary is trained by zstandard on ordinary text.  The toxic
dictionary is the same one followed by passages of toxic text, so the two differ in nothing but toxic matter, and words that have none gain
nothing.  The passages are those pieces of toxic text whose strings of ``GRAM`` bytes occur in far more toxic than ordinary texts; zstandard's own
trainer looks at one side only, and with what it picks the classes overlap widely.  How much more often is tried out.

Three numbers of a text, the largest gain, the bytes gained in windows above a threshold and the number of windows, go through a logistic curve.  The
threshold and the curve are fitted on labelled texts that the dictionaries did not see: the threshold that tells them best is taken.

The model is fitted on at most ``SAMPLE`` labelled rows of each class (in the order of a hash of ``doc_id``), half for the dictionaries and half
for threshold and curve; scoring is one narrow pass over all rows, in which a task keeps the gains of up to ``CACHE`` windows.

Defined cases: null, empty and blank texts have no windows and gain nothing; without labels of both classes every text gets the share of toxic
labels (0 without any label); long texts and words are read whole; repeated rows are scored alike; a null ``doc_id`` is not held out; rows with
null labels or texts are not learnt from; an empty table gives an empty result; other columns are not read, columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm._repeats import _texts

SAMPLE = 2_000
HELD_OUT_FOLD = 1
TOXIC_SCORE = 0.7
GRAM = 5
MORE_OFTEN = (2, 4, 8, 16)  # times as often in toxic texts: one of these, as the labelled texts tell
SURE = 3.0  # and so many standard deviations more often
LEAST_SHARE = 0.004  # of the toxic texts, and two of them
COMMON_BYTES, TOXIC_BYTES = 16 << 10, 8 << 10
PIECE, OVERLAP = 64, 16
THRESHOLDS = range(1, 9)
CACHE = 1 << 18
# Stands before and behind a window and at the end of both dictionaries: a compressed block then always has a match, so the first one in a window
# costs no more than the others, and matches may start at its last bytes.
MARK = b"~<^window^>~"
SEARCH = {"window_log": 16, "hash_log": 15, "chain_log": 15, "search_log": 5, "min_match": 6, "strategy": zstandard.STRATEGY_GREEDY,
          "write_content_size": 0, "write_dict_id": 0}

_gains: dict[bytes, dict[bytes, int]] = {}  # of this worker process, by model


def windows(text: bytes) -> list[bytes]:
    """The words of a text; what is longer than ``PIECE`` in pieces."""
    words = text.lower().split()
    if len(text) > PIECE and max(map(len, words), default=0) > PIECE:
        step = PIECE - OVERLAP
        words = [p for w in words for p in ([w] if len(w) <= PIECE else [w[i:i + PIECE] for i in range(0, len(w) - OVERLAP, step)])]
    return words


def grams(words: set[bytes]) -> set[bytes]:
    out: set[bytes] = set()
    for w in words:
        w = b" " + w + b" "
        out.update(w[i:i + GRAM] for i in range(len(w) - GRAM + 1))
    return out


def text_counts(texts: list[bytes]) -> Counter[bytes]:
    """In how many texts each string of ``GRAM`` bytes occurs."""
    held: Counter[bytes] = Counter()
    for text in texts:
        held.update(grams(set(windows(text))))
    return held


def toxic_passages(toxic: list[bytes], seen: Counter[bytes], usual: dict[bytes, float], more_often: float) -> list[bytes]:
    """Pieces of words of toxic texts that are rarer in ordinary ones, the commonest last, where a dictionary is best searched.

    ``seen``: toxic texts of a string; ``usual``: as many as there would be, were toxic texts like ordinary ones.
    """
    least = max(2, LEAST_SHARE * len(toxic))
    telling = {g for g, k in seen.items() if k >= least and k > more_often * usual[g] and k - usual[g] > SURE * math.sqrt(usual[g])}
    counts: Counter[bytes] = Counter()
    for text in toxic:
        for word, times in Counter(windows(text)).items():
            word = b" " + word + b" "
            at = [i for i in range(len(word) - GRAM + 1) if word[i:i + GRAM] in telling]
            if at:
                counts[word[at[0]:at[-1] + GRAM]] += times
    return sorted((p for p, k in counts.items() if k > 1), key=lambda p: (counts[p], p))


def common_dictionary(texts: list[bytes]) -> bytes:
    """Trained by zstandard; too few texts to train on are a dictionary themselves."""
    parts = [b" ".join(windows(t)) for t in texts]
    try:
        return zstandard.train_dictionary(COMMON_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(parts)[-COMMON_BYTES:]


class ToxicityModel:
    """The dictionaries, the threshold of a window's gain and the logistic curve over a text's three numbers."""

    def __init__(self, common: bytes = b"", toxic: bytes = b"", base: float = 0.0, threshold: int = 1, theta: np.ndarray | None = None):
        self.common, self.toxic, self.base, self.threshold, self.theta = common, toxic, base, threshold, theta

    def _tools(self) -> list[zstandard.ZstdCompressor]:
        search = zstandard.ZstdCompressionParameters(**SEARCH)
        tools = []
        for content in (self.common, self.common + self.toxic):
            made = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=search)
            tools.append(zstandard.ZstdCompressor(compression_params=search, dict_data=made))
        return tools

    def gains(self, texts: list[bytes]) -> list[Counter[int]]:
        """Of each text, how many windows gain so many bytes."""
        key = hashlib.sha256(self.common + self.toxic).digest()
        known = _gains.setdefault(key, {})
        ordinary, toxic = (tool.compress for tool in self._tools())
        out = []
        for text in texts:
            found: Counter[int] = Counter()
            for word, times in Counter(windows(text)).items():
                gain = known.get(word)
                if gain is None:
                    window = MARK + b" " + word + b" " + MARK
                    if len(known) >= CACHE:
                        known.clear()
                    gain = known[word] = len(ordinary(window)) - len(toxic(window))
                found[gain] += times
            out.append(found)
        return out

    @staticmethod
    def numbers(gains: list[Counter[int]], threshold: int) -> np.ndarray:
        rows = [(max(0, max(g, default=0)), np.log1p(sum(b * n for b, n in g.items() if b >= threshold)), np.log1p(sum(g.values())), 1.0) for g in gains]
        return np.array(rows, np.float64).reshape(-1, 4)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.theta is None:
            return np.full(len(texts), self.base)
        return logistic(self.numbers(self.gains(texts), self.threshold) @ self.theta)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def curve(design: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and weights of the logistic curve with a slight pull to zero, by Newton steps."""
    theta, pull = np.zeros(design.shape[1]), np.array([1e-2] * (design.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = logistic(design @ theta)
        gradient = design.T @ (w * (p - y)) + pull * theta
        curvature = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(pull)
        theta = theta - np.clip(np.linalg.solve(curvature, gradient), -5, 5)
    p = np.clip(logistic(design @ theta), 1e-12, 1 - 1e-12)
    return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + (pull * theta * theta).sum() / 2), theta


def fit(toxic: list[bytes], ordinary: list[bytes], base: float) -> ToxicityModel:
    """Even rows make the dictionaries, odd rows threshold and curve."""
    if not (toxic and ordinary):
        return ToxicityModel(base=base)
    common, shown = common_dictionary(ordinary[::2]), toxic[::2]
    seen, ordinary_counts = text_counts(shown), text_counts(ordinary[::2])
    scale = len(shown) / len(ordinary[::2])
    usual = {g: scale * (ordinary_counts[g] + 0.3) for g in seen}
    seen_toxic, seen_ordinary = toxic[1::2] or toxic, ordinary[1::2] or ordinary
    y = np.repeat([1.0, 0.0], [len(seen_toxic), len(seen_ordinary)])
    # The classes were sampled apart; weights bring them back to their shares.
    w = np.where(y == 1, base / len(seen_toxic), (1 - base) / len(seen_ordinary)) * len(y)
    tried = []
    for more_often in MORE_OFTEN:
        model = ToxicityModel(common, b"".join(toxic_passages(shown, seen, usual, more_often))[-TOXIC_BYTES:], base)
        gains = model.gains(seen_toxic + seen_ordinary)
        for threshold in THRESHOLDS:
            loss, theta = curve(model.numbers(gains, threshold), y, w)
            tried.append((loss, len(tried), ToxicityModel(model.common, model.toxic, base, threshold, theta)))
    return min(tried, key=lambda t: t[:2])[2]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT_FOLD, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from the labelled rows that are not held out; at most ``SAMPLE`` of a class come to the driver."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    base = counts.get(1, 0) / sum(counts.values()) if counts else 0.0
    # Ids are drawn first, so that only the sample's texts are sorted and sent.
    drawn = {toxic: known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for toxic in (0, 1)}
    texts = docs.filter("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    rows = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit(*[[r.text.encode() for r in found if r.toxic == toxic] for toxic in (1, 0)], base)


def score_toxicity(docs: DataFrame, model: ToxicityModel, toxic_score: float = TOXIC_SCORE) -> DataFrame:
    """All columns of ``docs`` but ``held_out``, ``score`` and ``predicted``, which are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_texts(batch["text"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    plain = docs.drop("held_out", "score", "predicted")
    scored = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("held_out", held_out()).withColumn("predicted", F.when(F.col("score") >= toxic_score, 1).otherwise(0))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")
