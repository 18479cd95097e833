"""The corpus pipeline: quality, near duplicates, benchmark passages, mix, shards.

Every stage takes what its predecessor kept, and all but the last return the columns of ``documents``. The
classifier can't be expressed in SQL, so the stages are tested against brute-force versions.

Edge cases: a null text counts as empty; without labels the classifier scores 0.5 and keeps all; rows without
an id are no near duplicates and stay; an empty table passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, mixing, quality, sharding, simhash
from millrace.llm._common import stash, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: fingerprints of at most four differing bits, or sets of
    five-word shingles with a similarity of 0.8 or more as their minima tell."""
    return simhash.keep_first(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("shards", shards),
]
#: The trained classifier of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
