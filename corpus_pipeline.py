"""A corpus cleaned and packed in five stages, each over all that its predecessor kept.

Every stage's result is written as Parquet in the folder that the cluster shares and read again, so a stage never runs
twice and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import exact_dedup, packing, secrets, simhash, toxicity
from tracequarry.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model rejects go."""
    return toxicity.kept(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest as written stays, then the smallest doc_id."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within two bits the smallest doc_id stays."""
    return simhash.representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in windows of 2048."""
    return packing.packed(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage), ("secret scans", secret_stage), ("packing", packing_stage)]

#: SQL can't say what a compression distance, a fingerprint or a tokenizer does: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
