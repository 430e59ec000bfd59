"""Five stages from raw documents to packed sequences. Each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import line_dedup, mixing, packing, quality_lines, sketch_dedup
from cadenza.llm.shared import DOCUMENT_COLUMNS, discard, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_lines.accepted(docs.select(*DOCUMENT_COLUMNS))


def frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the site-relative ratio go."""
    return line_dedup.without_frequent_lines(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least doc_id; rows that repeat it go too."""
    return sketch_dedup.without_near_copies(docs.select(*DOCUMENT_COLUMNS), words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' weights ask: each once at least, none above the repetition limit."""
    return mixing.mixed_documents(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row a piece."""
    return packing.packed(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", frequent_lines), ("near copies", near_copies), ("mixing", mixture), ("packing", packed)]

#: No SQL: tokenizer ids and sketches aren't SQL's. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage read is deleted once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
