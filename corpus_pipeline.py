"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, the documents that the stage before it left. All
but the last return the columns of ``docs``. Stages read their input more than once, so it should be a stored table.

Null and empty texts are documents like others: they are scored, are near copies of nothing, lose nothing, have no mass of their own and
are packed as an end alone. Null ids stay null and are no reason to drop a row; rows that repeat an id are told apart by their
texts. An empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovemark.llm import minhash, mixing, packing, quality, suffix_dedup
from grovemark.llm.common import Scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go; it learns from the labels beside the documents. Without usable labels all stay."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the smallest id, null the last; texts without words all stay."""
    return minhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """100-byte strings that start earlier are cut out of the texts; no document goes, whatever is left of it."""
    return suffix_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, null one of them, are repeated towards the square root of their mass, and all copies shuffled; a draw of 0 leaves a document out."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, every token of every row in one piece."""
    return packing.pack(docs, packing.vocabulary_file(), words=100_000, part_bytes=2 << 20)  # its workers serve the other stages too


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_filter),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", mix),
    ("packing", pack),
]

#: Learned scores, hashes and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir/documents.parquet, each stored before the next reads it."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
