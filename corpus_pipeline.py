"""Documents to training sequences: five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from larkspur.llm.common import cut, load


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return quality_rules.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go; documents stay, with an empty text if all their lines went.

    Emptied documents link with nothing later, mixing may repeat them, and packing gives each one piece of one token.
    """
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, Jaccard 0.8 or more) stays, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs, gram=5, link=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights, by repeating documents: the least repeated source is held once, so none is lost."""
    return mixing.repeated(docs, keep_all=True, max_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", reject_by_rules),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Mahalanobis distances, MinHash components, permutations and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
