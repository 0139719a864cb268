"""Scans of metadata, full texts, source catalogues and hierarchy maps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import items as it
from shelfmark.functions import text as tx
from shelfmark.functions.hierarchy import HIERARCHY_DELIMITER
from shelfmark.operators.merge import MARC_FIELDS, union_sources
from shelfmark.operators.skew import DOC


def _with_line_order(df: DataFrame) -> DataFrame:
    """Adds file, input split and running number of every line. Must sit directly on the scan."""
    return df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )


def number_lines(scan: DataFrame, name: str = DOC) -> DataFrame:
    """0-based line number over all files in path order: offset of the input split plus the place inside it.

    The offsets are one row per input split, so the single ordered sum stays small whatever the data size.
    """
    rows = _with_line_order(scan)
    splits = rows.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    splits = splits.withColumn("_before", F.sum("_n").over(Window.orderBy("_file", "_split")) - F.col("_n"))
    # one row per input split; without the hint the lines are shuffled before the size of the other side is known
    numbered = rows.join(F.broadcast(splits.drop("_n")), ["_file", "_split"])
    return numbered.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).select(name, *scan.columns)


def scan_metadata(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; every column is a string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per line."""
    return spark.read.text(path).withColumnRenamed("value", "fulltext")


def scan_documents(
    spark: SparkSession, metadata: str, texts: str | None = None, fields: list[str] | None = None,
    delimiter: str | None = it.ITEM_DELIMITER,
) -> DataFrame:
    """Metadata fields as item lists with a document number; texts are only read when asked for.

    Line i of the text belongs to row i of the metadata. Extra lines are ignored, missing lines are an error.
    """
    rows = number_lines(scan_metadata(spark, metadata))
    fields = fields or [c for c in rows.columns if c != DOC]
    docs = rows.select(DOC, *[it.split_items(F.col(f"`{f}`"), delimiter).alias(f) for f in fields])
    return docs if texts is None else align(docs, number_lines(scan_texts(spark, texts)))


def align(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Join metadata rows and text lines by number; a row without a line raises when the query runs."""
    missing = F.raise_error(F.concat(F.lit("no text line for metadata row "), F.col(DOC).cast("string")))
    text = F.when(F.col("fulltext").isNull(), missing.cast("string")).otherwise(F.col("fulltext"))
    return docs.join(lines, DOC, "left").withColumn("fulltext", text)


def scan_source(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records without quoting: id and the MARC fields; short lines are dropped, extra columns ignored."""
    names = ("id", *MARC_FIELDS)
    lines = _with_line_order(spark.read.text(path)).withColumn("_parts", F.split("value", "\t", -1))
    order = F.struct("_file", "_split", "_at").alias("line_no")
    return (
        lines.filter((F.size("_parts") >= len(names)) & (F.get("_parts", F.lit(0)) != ""))
        .select(order, *[F.get("_parts", F.lit(i)).alias(n) for i, n in enumerate(names)])
        .withColumn("id", F.get(it.split_items("id"), F.lit(0)))
    )


def scan_sources(spark: SparkSession, catalogue: list[dict]) -> DataFrame:
    """All sources of a catalogue ``name, priority, file``; missing and empty files are skipped."""
    found = []
    for entry in catalogue:
        try:
            df = scan_source(spark, entry["file"])
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        found.append((df.withColumn("source", F.lit(entry["name"])), int(entry["priority"])))
    if not found:
        raise FileNotFoundError("no source of the catalogue exists")
    return union_sources(found)


def scan_hierarchy(spark: SparkSession, path: str, delimiter: str = HIERARCHY_DELIMITER) -> DataFrame:
    """``category, path`` from a tab-separated map; the last line of a category wins."""
    parts = F.transform(F.split("value", "\t", -1), it.strip)
    lines = _with_line_order(spark.read.text(path)).withColumn("_parts", parts)
    rows = lines.select(
        F.lower(F.get("_parts", F.lit(0))).alias("category"),
        F.array_join(F.slice("_parts", F.lit(2), F.size("_parts")), delimiter).alias("path"),
        F.struct("_file", "_split", "_at").alias("_order"),
    )
    return rows.groupBy("category").agg(F.max_by("path", "_order").alias("path"))


def scan_text_folder(spark: SparkSession, folder: str, id_pattern: str = r"([^/]*)\.txt$") -> DataFrame:
    """``id, fulltext`` from one file per document; lines are stripped and joined by one blank, empty files skipped.

    ``id_pattern`` finds the id in the file path.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.url_decode("_metadata.file_path"), id_pattern, 1)
    body = F.regexp_replace("value", r"(\r\n|\r|\n)\z", "")
    lines = F.transform(F.split(body, "\r\n|\r|\n", -1), it.strip)
    return files.filter(F.length("value") > 0).select(name.alias("id"), F.array_join(lines, " ").alias("fulltext"))


def empty_as_missing(df: DataFrame, *fields: str) -> DataFrame:
    """One canonical form for an empty field: null."""
    return df.withColumns({f: F.when(~it.is_empty(f), F.col(f)) for f in fields})


def tokens(df: DataFrame, text: str = "fulltext", name: str = "words") -> DataFrame:
    return df.withColumn(name, tx.words(text))
