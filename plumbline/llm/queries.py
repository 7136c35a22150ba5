"""Named queries of this package and, where SQL can express them, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.embedding_dedup import OP4_SQL, op4_embedding_dedup
from plumbline.llm.html_extraction import op5_html_extraction
from plumbline.llm.merkle_manifest import OP13_SQL, op13_merkle_manifest
from plumbline.llm.minhash_dedup import op2_minhash_dedup
from plumbline.llm.multi_index import op7_multi_index
from plumbline.llm.quality_classifier import op3_quality_classifier
from plumbline.llm.sentencepiece_sampling import op8_sentencepiece
from plumbline.llm.source_mixing import OP9_SQL, op9_source_mixing
from plumbline.llm.spelling_variants import OP12_SQL, op12_spelling_variants
from plumbline.llm.substring_dedup import op6_substring_dedup
from plumbline.llm.suffix_dedup import op1_suffix_dedup
from plumbline.llm.toxicity import op11_toxicity
from plumbline.llm.url_filter import op10_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_minhash_dedup, op3_quality_classifier, op4_embedding_dedup, op5_html_extraction,
              op6_substring_dedup, op7_multi_index, op8_sentencepiece, op9_source_mixing, op10_url_filter,
              op11_toxicity, op12_spelling_variants, op13_merkle_manifest)
}
ORACLES: dict[str, str] = {"op4_embedding_dedup": OP4_SQL, "op9_source_mixing": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
