"""Queries of the corpus operators over the driver's tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_bpe

    return piece_bpe.digests(table(spark, sf_dir, "documents"), piece_bpe.default_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store

    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    return passages.repeated(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.packed(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_toxicity, op4_exact_dedup, op5_line_dedup, op6_secrets, op7_token_store, op8_passages, op9_packing, op10_ann)}


EXACT = r"""SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY own) AS group_size, row_number() OVER w = 1 AS kept, sha256(own) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS own FROM documents) d
WINDOW w AS (PARTITION BY own ORDER BY length(text) DESC, doc_id NULLS LAST)"""


def oracle_sql() -> dict[str, str]:
    """Of the others SQL can't say the result, or not on whole tables: tests/llm holds them against brute force."""
    return {"op4_exact_dedup": EXACT}
