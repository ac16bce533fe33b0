"""Quality rules, near-duplicates, benchmark decontamination, mixing, token output: one stage after another over documents.

Each stage works on all rows that the one before it kept, and all but the last return the columns of documents, whatever
others there are besides doc_id, text, lang and source. Defined results: null and empty texts fail the quality rules, so no later
stage meets them unless it is called by itself; an empty table passes through all stages and gives no token rows; of repeated
rows one stays; equal values are treated alike by every rule; a very long text is one row until it is packed, where it
is split over rows without loss. See each operator's module for its own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm import decontaminate, mixing, neardup, packing, quality
from lociweave.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's bounds."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words (or a whole shorter item) of benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents left out or repeated so that the sources come near their targets."""
    return mixing.mix(docs)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token rows", token_rows),
]

#: Shingle overlaps of whole groups, and byte-pair encoding, are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
