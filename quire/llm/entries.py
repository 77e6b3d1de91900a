"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .context_tree import score_texts
from .decontamination import contaminated
from .html_text import OP11_SQL, page_texts
from .jaccard import jaccard_components
from .merkle import OP12_SQL, document_proofs
from .mixing import OP1_SQL, mix_sources
from .neighbours import nearest
from .paragraphs import repeated_spans
from .preference import OP9_SQL, neighbour_pairs
from .quality import quality
from .sessions import OP13_SQL, conversation_sessions
from .token_counts import length_histogram, suffix_sums
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix: sources weigh 5, 2, 1, repeating, and share 150 % of all words."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    return suffix_sums(length_histogram(_table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; ids with crc32 modulo 4 = 2 are held out of the fit."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets overlap by 85 % or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; ids with crc32 modulo 3 = 1 are held out of the fit."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by inner product, of each row whose id is divisible by 20."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages to remove: the document, the span in words, and the document that keeps the passage."""
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds within the item's edit budget."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as preference pairs: an even id is chosen over the next."""
    return neighbour_pairs(_table(spark, sf_dir, "conversations"))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; ids with crc32 modulo 7 = 2 are held out of the fit."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return score_texts(_table(spark, sf_dir, "documents"), fold == 2)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, blocks joined by line ends."""
    return page_texts(_table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root folded anew from its leaf, tampered with or not."""
    return document_proofs(_table(spark, sf_dir, "documents"))


def op13_session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every user's sessions, with the version that retracts it; events at most 240 seconds apart share one."""
    return conversation_sessions(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_token_counts, op3_quality, op4_jaccard_join, op5_toxicity, op6_neighbours, op7_paragraph_dedup, op8_decontamination, op9_preference, op10_context_tree, op11_main_text, op12_merkle_manifest, op13_session_versions)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op9_preference": OP9_SQL, "op11_main_text": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_session_versions": OP13_SQL}
