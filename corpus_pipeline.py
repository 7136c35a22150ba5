"""Corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

1. quality: documents that the compression classifier rejects go;
2. near duplicates: of each class of near-duplicate texts the smallest ``doc_id`` stays;
3. repeated passages: bytes of windows that also start in a smaller document go (a character that loses a byte
   goes whole), documents of which nothing is left but white space go;
4. mixing: documents are repeated or left out until each source has its share of all words;
5. pieces: one row a document taken, with its SentencePiece ids, distinct sampled segmentations, and numbers and digests of both.

All stages but the last return the columns of ``documents``, with ``n_chars`` kept true to ``text``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.minhash_dedup import near_duplicates
from plumbline.llm.quality_classifier import fit_quality, score_quality
from plumbline.llm.sentencepiece_sampling import encode_and_sample
from plumbline.llm.source_mixing import mix_sources
from plumbline.llm.suffix_dedup import Readable, remove_repeated_bytes
from plumbline.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; the model is fitted on the labelled rows of these documents."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; blank texts and documents without an id are no one's duplicates."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a smaller document holds; texts left blank by that go."""
    cut = remove_repeated_bytes(docs.select("doc_id", "text", "lang", "source"), kind=Readable, carry=["lang", "source"])
    emptied = (F.col("n_removed") > 0) & (F.length(F.trim("kept")) == 0)
    return cut.filter(~emptied).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(docs, F.array("source"), keep=COLUMNS).rows
    return mixed.filter("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document taken; a document taken several times is encoded once."""
    times = docs.groupBy("doc_id", "text").agg(F.count("*").alias("times"))
    encoded = encode_and_sample(times, digests=True, carry=["times"])
    return encoded.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicate), ("repeated_passages", repeated_passages), ("mixing", mixing), ("pieces", pieces),
]
ORACLE_SQL = None  # no stage but mixing can be told in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
