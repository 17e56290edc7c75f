"""The training-data operators as queries over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_extract, mixing, packing, quality, sharding, simhash, substrings, token_counts, topk
from .runtime import table


#: Vocabulary file of op10, unless the session names another in ``spark.penstroke.vocabulary``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of all documents."""
    return fingerprints.weighted_signatures(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of all documents, by a model fitted to the labelled ones."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of those whose id is divisible by 50."""
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: ``doc_id, kept_doc_id``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal repeats of 50 words or more among all documents, each with its first occurrence."""
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, balanced by bytes, tokens and rows."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of related documents over all documents."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture, by shard and block."""
    return mixing.selected(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), spark.conf.get("spark.penstroke.vocabulary", VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_exact_topk": op4_exact_topk,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {
    "op4_exact_topk": topk.NEAREST_SQL,
    "op6_substring_dedup": substrings.REPEATS_SQL,
    "op9_mixing_sources": mixing.SELECTED_SQL,
}
