"""A training-text pipeline: quality, near duplicates, decontamination, personal data, mixing.

Each stage takes all documents that the one before it kept, reads no more than doc_id, text and
source of them, and returns their columns unchanged (the last one too, repeated rows being the
mixture). Stages are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontam, mixing, near_dup, pii, quality
from skein.llm.common import save, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The discriminant is fitted on the labelled documents; those it scores below one half go."""
    model = quality.fit(quality.describe(docs), quality.teachers(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the least doc_id."""
    return near_dup.deduplicate(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; all documents stay."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("pii_redaction", redact_personal_data),
    ("source_mixing", mix_sources),
]

#: The stages run Arrow code and iterate, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
