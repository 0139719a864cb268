"""Counts of documents, items, targets and hierarchy branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import hierarchy
from shelfmark.operators.skew import DOC


def explode_fields(df: DataFrame, fields: list[str], doc: str = DOC) -> DataFrame:
    """One row per item: ``doc, field, pos, item``. All fields in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("items")) for f in fields]))
    return df.select(doc, pairs.alias("_f")).select(doc, "_f.field", F.posexplode("_f.items").alias("pos", "item"))


def items_per_field(df: DataFrame, fields: list[str], doc: str = DOC) -> DataFrame:
    """Documents per item; an item repeated in one document counts each time."""
    return explode_fields(df, fields, doc).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))


def documents_per_target(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n_docs"))


def descending(counts: DataFrame, n: str = "n_docs", name: str = "target") -> DataFrame:
    """Listing by descending count, ties by name."""
    return counts.orderBy(F.desc(n), F.asc(name))


def target_summary(df: DataFrame, target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Number of documents, of distinct targets and of distinct predictions; '' is no prediction."""
    return df.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_distinct(F.col(target)).alias("n_targets"),
        F.count_distinct(F.when(F.col(predicted) != "", F.col(predicted))).alias("n_predicted"),
    )


def branch_counts(df: DataFrame, target: str = "target", delimiter: str = hierarchy.HIERARCHY_DELIMITER) -> DataFrame:
    """Documents under every path prefix. Equal targets are counted first, so only distinct paths are expanded."""
    per_target = documents_per_target(df.filter(F.col(target).isNotNull()), target)
    prefix = F.explode(hierarchy.path_prefixes("target", delimiter)).alias("prefix")
    return (
        per_target.select("n_docs", prefix)
        .groupBy(F.array_join("prefix", delimiter).alias("path"), F.size("prefix").alias("depth"))
        .agg(F.sum("n_docs").alias("n_docs"))
    )
