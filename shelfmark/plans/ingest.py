"""The four ingest jobs: multi-source merge, text export, metadata export, digital-library conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import items as it
from shelfmark.operators import merge
from shelfmark.sources import digital_library, marc, relational


def merge_sources(
    records: DataFrame,
    texts: DataFrame | None,
    *,
    fields: list[str] = list(merge.MARC_FIELDS),
    target_field: str = "072",
    hierarchy: DataFrame | None = None,
    hierarchy_field: str = "hierarchy",
    lexicon: DataFrame | None = None,
    lemmatised_fields: list[str] = (),
    lemma_suffix: str = "_lemm",
    allow_empty_text: bool = False,
    delimiter: str = it.ITEM_DELIMITER,
) -> DataFrame:
    """One row per record id with its united fields, hierarchy field, lemmatised fields and full text.

    ``texts`` is None for a metadata-only run. Everything stays one long item table until the final grouping.
    """
    if texts is not None and not allow_empty_text:
        records = merge.with_content(records, texts)
    items = merge.merge_records(records, fields, delimiter=delimiter)
    parts, names = [items], list(fields)
    if hierarchy is not None:
        mapped = merge.map_to_hierarchy(items.filter(F.col("field") == target_field), hierarchy)
        parts.append(merge.unite_items(mapped.withColumn("field", F.lit(hierarchy_field))))
        names.insert(names.index(target_field) + 1, hierarchy_field)
    if lexicon is not None and lemmatised_fields:
        chosen = items.filter(F.col("field").isin(list(lemmatised_fields)))
        lemmas = merge.lemmatise_items(chosen, lexicon)
        parts.append(lemmas.withColumn("field", F.concat("field", F.lit(lemma_suffix))))
        names += [f + lemma_suffix for f in lemmatised_fields]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    values = merge.ordered_values(long)
    cells = [
        F.coalesce(F.max(F.when(F.col("field") == n, F.array_join("values", delimiter))), F.lit("")).alias(n) for n in names
    ]
    # the ids come from the records, so that a record without any item is still written
    rows = records.select("id").distinct().join(values.groupBy("id").agg(*cells), "id", "left")
    rows = rows.select("id", *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
    return rows if texts is None else merge.attach_text(rows, texts, allow_empty_text)


def export_texts(fulltext: DataFrame, harvested: DataFrame, pages_per_part: int = 1000) -> DataFrame:
    """``group_id, text``: the pages of all records of a group, stitched."""
    pages = merge.with_group(relational.record_pages(fulltext), relational.record_groups(harvested))
    return merge.stitch_groups(merge.stitch_parts(pages, pages_per_part))


def export_metadata(
    harvested: DataFrame, import_conf: DataFrame, dedup: DataFrame | None = None, last_only: bool = False
) -> DataFrame:
    """``library_id, id`` and the MARC fields per library and group; rows without any value are left out."""
    records = harvested.filter(F.length("raw_record") > 0)
    if dedup is not None:
        records = records.join(dedup.select(F.col("id").alias("dedup_record_id")), "dedup_record_id", "left_semi")
    library = import_conf.select(F.col("id").alias("import_conf_id"), "library_id")
    parsed = marc.parse_records(records.join(library, "import_conf_id").withColumnRenamed("id", "record_id"))
    keys = ["library_id", "dedup_record_id"]
    values = marc.field_values(parsed, [*keys, "record_id"])
    rows = marc.collect_fields(values, keys, last_only=last_only).withColumnRenamed("dedup_record_id", "id")
    filled = F.trim(F.concat_ws("", *[F.col(f"`{f}`") for f in merge.MARC_FIELDS])) != ""
    return rows.filter(filled)


def convert_library(documents: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertical text chunks and the references whose page is missing."""
    return digital_library.vertical_text(documents, pages), digital_library.page_errors(documents, pages)
