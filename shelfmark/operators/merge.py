"""Merging records of several prioritised sources, and stitching pages to texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import items as it
from shelfmark.functions import text as tx
from shelfmark.operators.skew import lookup_join

# The exported MARC fields in file order, and those whose items are united over sources.
MARC_FIELDS = (
    "008", "072", "080", "600", "610", "611", "630", "648", "100",
    "650", "651", "653", "655", "670", "678", "695", "964", "245",
)
MULTI_ITEM_FIELDS = ("080", "650", "611", "630", "653", "610", "655", "600", "964", "072", "651", "648")


def union_sources(sources: list[tuple[DataFrame, int]]) -> DataFrame:
    """Records of all sources with their priority; equal priorities keep the given order."""
    tagged = [
        df.withColumn("priority", F.lit(priority)).withColumn("source_no", F.lit(n))
        for n, (df, priority) in enumerate(sources)
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def record_items(records: DataFrame, fields: list[str], delimiter: str = it.ITEM_DELIMITER) -> DataFrame:
    """``id, priority, field, position, value`` per item."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), it.split_items(F.col(f"`{f}`"), delimiter).alias("items")) for f in fields]
    )
    rows = records.select("id", "priority", F.explode(pairs).alias("_p"))
    return rows.select("id", "priority", "_p.field", F.posexplode("_p.items").alias("position", "value"))


def unite_items(items: DataFrame) -> DataFrame:
    """One entry per value: highest priority, then lowest position.

    Values are reduced before the sorted list is built, so a record with very many lines shrinks map-side.
    """
    best = F.min(F.struct((-F.col("priority")).alias("p"), F.col("position").alias("pos"))).alias("_best")
    return items.groupBy("id", "field", "value").agg(best).select(
        "id", "field", "value", (-F.col("_best.p")).alias("priority"), F.col("_best.pos").alias("position")
    )


def first_record_items(
    records: DataFrame, fields: list[str], delimiter: str = it.ITEM_DELIMITER, order: tuple = ("source_no", "line_no")
) -> DataFrame:
    """Items of the first record that fills the field; later records only fill what is still empty.

    One aggregate with map-side combine picks the record, whatever the number of records of an id.
    """
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), it.split_items(F.col(f"`{f}`"), delimiter).alias("items")) for f in fields]
    )
    seen = F.struct((-F.col("priority")).alias("priority"), *order)
    rows = records.select("id", "priority", seen.alias("seen"), F.explode(pairs).alias("_p"))
    filled = rows.select("id", "priority", "seen", "_p.field", "_p.items").filter(F.size("items") > 0)
    first = filled.groupBy("id", "field").agg(F.min_by(F.struct("priority", "items"), "seen").alias("_first"))
    items = first.select("id", "field", "_first.priority", F.posexplode("_first.items").alias("position", "value"))
    return items.groupBy("id", "field", "value", "priority").agg(F.min("position").alias("position"))


def ordered_values(items: DataFrame) -> DataFrame:
    """``id, field, values``: priority descending, position ascending, value as the last tie-break."""
    entry = F.struct((-F.col("priority")).alias("p"), F.col("position").alias("pos"), "value")
    listed = items.groupBy("id", "field").agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    return listed.select("id", "field", F.col("_list.value").alias("values"))


def merge_records(
    records: DataFrame, fields, multi_item_fields=MULTI_ITEM_FIELDS, delimiter: str = it.ITEM_DELIMITER
) -> DataFrame:
    """Full merge by id: united items for the multi-item fields, first filled record for the others."""
    columns = ["id", "field", "value", "priority", "position"]
    multi = [f for f in fields if f in multi_item_fields]
    single = [f for f in fields if f not in multi_item_fields]
    united = unite_items(record_items(records, multi, delimiter)).select(*columns)
    return united.unionByName(first_record_items(records, single, delimiter).select(*columns))


def with_content(records: DataFrame, texts: DataFrame, id: str = "id") -> DataFrame:
    """Records whose full text exists and is not empty."""
    return records.join(texts.filter(F.length("fulltext") > 0).select(id), id, "left_semi")


def attach_text(records: DataFrame, texts: DataFrame, allow_empty: bool, id: str = "id") -> DataFrame:
    """Records with their full text; without one they are dropped, or kept with '' when allowed."""
    filled = texts.filter(F.length("fulltext") > 0).select(id, "fulltext")
    if not allow_empty:
        return records.join(filled, id)
    return records.join(filled, id, "left").withColumn("fulltext", F.coalesce("fulltext", F.lit("")))


def map_to_hierarchy(items: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Replace each category by its path; unmapped categories are dropped (see :func:`unmapped`)."""
    keyed = items.withColumn("category", F.lower(it.strip("value")))
    return lookup_join(keyed, hierarchy, ["category"]).drop("category", "value").withColumnRenamed("path", "value")


def unmapped(items: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Categories without a path, with their number of items. Counted before the join."""
    counts = items.groupBy(F.lower(it.strip("value")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(hierarchy, "category", "left_anti")


def lemmatise_items(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Items as lemmas, signs removed; items that become equal collapse. Each distinct value is analysed once."""
    values = items.select("value").distinct().withColumn("pos_form", tx.words(tx.signs_to_spaces("value")))
    rows = values.select("value", F.posexplode_outer("pos_form").alias("pos", "form"))
    known = lookup_join(rows, lexicon.select("form", "lemma"), ["form"], "left")
    entry = F.when(F.col("form").isNotNull(), F.struct("pos", F.coalesce("lemma", "form").alias("lemma")))
    lemmas = known.groupBy("value").agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    lemmas = lemmas.select("value", F.array_join("_list.lemma", " ").alias("_lemma"))
    renamed = lookup_join(items, lemmas, ["value"]).drop("value").withColumnRenamed("_lemma", "value")
    return unite_items(renamed)


def with_group(records: DataFrame, groups: DataFrame, id: str = "record_id") -> DataFrame:
    """Record to group id by lookup; records without one are left out (see :func:`without_group`)."""
    return records.join(groups.filter(F.col("group_id").isNotNull()), id)


def without_group(records: DataFrame, groups: DataFrame, id: str = "record_id") -> DataFrame:
    return records.select(id).distinct().join(groups.filter(F.col("group_id").isNotNull()), id, "left_anti")


def stitch_parts(pages: DataFrame, pages_per_part: int = 1000) -> DataFrame:
    """Pages of a record in page order as parts of bounded size: ``group_id, record_id, part_no, text``.

    A record of any length is spread over its parts. Clean-up is local to a page, because pages are joined by a blank.
    """
    part = F.floor(F.col("page_no") / F.lit(pages_per_part)).cast("bigint").alias("part_no")
    entry = F.struct("page_no", tx.join_hyphenated("text").alias("text"))
    listed = pages.groupBy("group_id", "record_id", part).agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    return listed.select("group_id", "record_id", "part_no", F.array_join("_list.text", " ").alias("text"))


def stitch_groups(parts: DataFrame) -> DataFrame:
    """Whole text per group, one row each as the export wants it; built from the parts, not from the pages."""
    entry = F.struct("record_id", "part_no", "text")
    listed = parts.groupBy("group_id").agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    return listed.select("group_id", F.array_join("_list.text", " ").alias("text"))
