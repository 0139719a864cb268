"""The corpus pipeline: language, near copies, benchmark passages, secrets, mixture.

Each stage reads what its predecessor kept, as a Parquet table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontamination, dedup, language, mixing, secrets
from shelfmark.llm.common import read, saved

# A text whose best language scores less than this shares next to nothing with the learned languages; texts of one short
# word scored from 0.12 on, and so can texts of an unlearned language in the same script; other scripts score 0.
LEAST_LANGUAGE_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of the languages learned from the documents; the rest has no letters or no language."""
    model = language.fit(docs)
    marked = language.identify(docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text")), model, text="_text", keep=["_doc"])
    kept = marked.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontamination.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets of few sources in the texts; examples that many sources copy stay."""
    masked = secrets.mask_live(docs, F.col("source"), secrets.name(F.col("source"), F.col("lang")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture of sources takes."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", secret_scan),
    ("mixing", mixture),
]

# Kernels, sketches and verified edits are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
