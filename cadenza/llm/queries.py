"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, embed_dedup, html_extract, license_scan, line_dedup, lloyd_codes, mixing, packing, pii_crf, prefix_trie, quality_lines, sketch_dedup, warc_archive
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.personal_data(table(spark, sf_dir, "documents"))


def op3_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.judged(table(spark, sf_dir, "documents")).drop("host", "page")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_copies(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_frequent_lines(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op11_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archived(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.hundred_heads(table(spark, sf_dir, "conversations")).drop("digest")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (op1_main_text, op2_personal_data, op3_quality_lines, op4_licences, op5_near_vectors, op6_near_copies, op7_packing, op8_frequent_lines, op9_repeated_passages, op10_mixture, op11_web_archive, op12_vector_codes, op13_prefix_trie, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
