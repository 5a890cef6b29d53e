"""The ``opN_<name>`` queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import table
from .embedding_dedup import near_duplicate_vectors
from .hard_negatives import mine_negatives
from .html_text import extract_pages
from .lexical import rank_documents
from .mixing import mix_sources
from .packing import pack_documents
from .pii import find_pii
from .quality import filter_quality
from .search import top_products
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .tokenizing import Vocabulary
from .toxicity import score_toxicity
from .tokens import read_token_digests, write_token_blocks

BYTE_BPE = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), drops_case=False)
BYTE_END = 2
WORD_BPE = Vocabulary(public_tokenizers.path("word_bpe_49k.json"), drops_case=True, memo_bytes=64 << 20)  # the pipeline's workers hold other stages' memory too
WORD_END = 1


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    out = filter_quality(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents' ids, read back from the blocks."""
    return read_token_digests(write_token_blocks(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_END))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find_pii(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece in sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, WORD_END)


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("kept"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, by cosine."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_token_ids": op2_token_ids,
        "op3_pii": op3_pii,
        "op4_html": op4_html,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_packing": op7_packing,
        "op8_top_products": op8_top_products,
        "op9_repeats": op9_repeats,
        "op10_simhash": op10_simhash,
        "op11_embedding_near_dedup": op11_embedding_near_dedup,
        "op12_lexical_search": op12_lexical_search,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": oracle.quality_sql(),
        "op6_mixing": oracle.mixing_sql(),
        "op8_top_products": oracle.TOP_PRODUCTS_SQL,
        "op11_embedding_near_dedup": oracle.EMBEDDING_NEAR_DEDUP_SQL,
        "op12_lexical_search": oracle.LEXICAL_SEARCH_SQL,
        "op13_hard_negatives": oracle.HARD_NEGATIVES_SQL,
    }
