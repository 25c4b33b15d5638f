"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.

Defined results of every stage: a null text is an empty one; rows with a null or repeated doc_id, and equal rows, are rows of their own; an empty table gives
an empty one; all columns of ``docs`` come out as they went in, whatever their names, but for the last stage, which returns places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, mixing, quality, sharding, simhash
from textloom.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based classifier accepts; it learns from the labelled ones among ``docs``.

    Decided row by row: equal texts get one decision.  Without labels every document stays (all scores are 0.5, the threshold).
    """
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints: the first by doc_id (nulls last), then by a hash of the text.

    Texts without words have one fingerprint, so one of them stays.
    """
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found and verified; null and empty items, and null and empty texts, match nothing."""
    return decontaminate.clean(docs, decontaminate.benchmark_items(table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; one without words is never taken.

    A null source is a source.  Where ids repeat or are null, each row draws for itself.
    """
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row, from the shards as written.

    The written files have all columns of ``docs``; the result has doc_id, size, text_crc32, law, shard, slot, grown_shard and old_shard.
    """
    return sharding.resharded(docs, sharding.old_layout(), sharding.OLD_SHARDS, sharding.NEW_SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No SQL trains the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
