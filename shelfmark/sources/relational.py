"""Relational sources, read in parallel by key range. Every export is one set-based job, not one query per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession, url: str, name: str, key: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1,
    properties: dict | None = None,
) -> DataFrame:
    """A database table; with a numeric ``key`` the range is read by ``parts`` connections."""
    if key is None:
        return spark.read.jdbc(url, name, properties=properties or {})
    return spark.read.jdbc(
        url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties or {}
    )


def record_pages(fulltext: DataFrame) -> DataFrame:
    """``record_id, page_no, text`` of the page table; texts may be stored as bytes."""
    text = F.col("fulltext")
    if dict(fulltext.dtypes)["fulltext"] == "binary":
        text = F.decode(text, "UTF-8")
    return fulltext.select(
        F.col("harvested_record_id").alias("record_id"), F.col("order_in_document").cast("bigint").alias("page_no"),
        text.alias("text"),
    )


def record_groups(harvested: DataFrame) -> DataFrame:
    return harvested.select(F.col("id").alias("record_id"), F.col("dedup_record_id").alias("group_id"))


def library_map(libraries: DataFrame) -> DataFrame:
    """Lines ``id<TAB>name`` of the library list."""
    return libraries.select(F.concat_ws("\t", F.col("id").cast("string"), "name").alias("value"))
