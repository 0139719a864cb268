"""Queries over scans, item expressions, filters and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import fixtures as fx
from shelfmark.checks.registry import query
from shelfmark.functions import items as it
from shelfmark.operators import counts, filters
from shelfmark.operators.skew import DOC, dense_index
from shelfmark.plans import commands
from shelfmark.session import scratch_path
from shelfmark.sources import files, sinks

FIELDS = fx.RECORD_FIELDS
RECORDS, ITEMS, DOCS = fx.RECORDS_SQL, fx.RECORD_ITEMS_SQL, fx.DOCS_SQL


def flat(df, *fields, extra=()):
    """Item lists as readable strings, so that both engines return plain columns."""
    return df.select(DOC, *extra, *[F.array_join(f, "|").alias(f) for f in fields])


def flat_sql(*fields):
    return ", ".join(f"array_to_string({f}, '|') as {f}" for f in fields)


def _written_records(spark, sf):
    path = scratch_path(spark, "meta.csv")
    sinks.write_metadata(fx.record_items(spark, sf), path, FIELDS)
    return path


WRITTEN = f"with {ITEMS} select " + ", ".join(f"array_to_string({f}, '$|$') as {f}" for f in FIELDS) + " from fx_items"


@query("a01_metadata_scan", WRITTEN)
def a01(spark, sf):
    df = files.scan_metadata(spark, _written_records(spark, sf))
    return df.select(*[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS])


TEXT_LINES = f"""with {DOCS}, numbered as (
select row_number() over (order by doc_idx) - 1 as doc_idx, {fx.words_sql('fulltext')} as words, target from fx_docs)"""


def _written_texts(spark, sf):
    path = scratch_path(spark, "data.txt")
    sinks.write_texts(files.tokens(fx.docs(spark, sf)), path)
    return path


@query("a02_text_scan", TEXT_LINES + " select len(words) as n_words, array_to_string(words, ' ') as fulltext from numbered")
def a02(spark, sf):
    df = files.tokens(files.scan_texts(spark, _written_texts(spark, sf)))
    return df.select(F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("fulltext"))


@query("a03_aligned_scan", TEXT_LINES + " select doc_idx, target, array_to_string(words, ' ') as fulltext from numbered")
def a03(spark, sf):
    meta = scratch_path(spark, "meta.csv")
    d = fx.docs(spark, sf).withColumn("target", it.split_items("target"))
    sinks.write_metadata(d, meta, ["target"])
    df = files.scan_documents(spark, meta, _written_texts(spark, sf))
    return flat(df, "target", extra=["fulltext"])


@query("a04_metadata_only_scan", f"with {ITEMS} select row_number() over (order by doc_idx) - 1 as doc_idx, {flat_sql('status', 'brands')} from fx_items")
def a04(spark, sf):
    df = files.scan_documents(spark, _written_records(spark, sf), fields=["status", "brands"])
    return flat(df, "status", "brands")


FIELD_COUNTS = " union all ".join(
    f"select '{f}' as field, item, count(*) as n from (select unnest({f}) as item from {{t}}) group by item" for f in FIELDS
)


@query("a05_unfiltered_counts", f"with {ITEMS} " + FIELD_COUNTS.format(t="fx_items"))
def a05(spark, sf):
    df = files.scan_documents(spark, _written_records(spark, sf))
    return counts.items_per_field(df, FIELDS)


@query("a12_metadata_sink", WRITTEN)
def a12(spark, sf):
    df = files.scan_metadata(spark, _written_records(spark, sf))
    return df.select(*[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS])


@query("a13_text_sink", TEXT_LINES + " select array_to_string(words, ' ') as line from numbered")
def a13(spark, sf):
    return spark.read.text(_written_texts(spark, sf)).withColumnRenamed("value", "line")


@query("a14_aligned_sink", TEXT_LINES + " select doc_idx, target, array_to_string(words, ' ') as fulltext from numbered")
def a14(spark, sf):
    meta, texts = scratch_path(spark, "meta.csv"), scratch_path(spark, "data.txt")
    d = files.tokens(fx.docs(spark, sf)).withColumn("target", it.split_items("target"))
    sinks.write_documents(d, meta, texts, scratch_path(spark, "table"), ["target"])
    return flat(files.scan_documents(spark, meta, texts), "target", extra=["fulltext"])


@query("b01_split_items", f"with {ITEMS} select doc_idx, {flat_sql(*FIELDS)} from fx_items")
def b01(spark, sf):
    return flat(fx.record_items(spark, sf), *FIELDS)


@query("b02_select_items", f"""with {ITEMS} select doc_idx, coalesce(brands[2], '') as one,
array_to_string(brands[2:3], '|') as range_of, array_to_string(list_filter(types, lambda x, i: i>=2 and i<=6 and (i-2)%2=0), '|') as stepped from fx_items""")
def b02(spark, sf):
    return fx.record_items(spark, sf).select(
        DOC,
        F.array_join(it.select_items("brands", 1), "|").alias("one"),
        F.array_join(it.select_items("brands", slice(1, 3)), "|").alias("range_of"),
        F.array_join(it.select_items("types", slice(1, 6, 2)), "|").alias("stepped"),
    )


@query("b03_select_words", f"""with {DOCS}, w as (select doc_idx, {fx.words_sql('fulltext')} as words from fx_docs)
select doc_idx, coalesce(words[1], '') as first_word, array_to_string(words[4:9], ' ') as some_words from w""")
def b03(spark, sf):
    return files.tokens(fx.docs(spark, sf)).select(
        DOC,
        F.array_join(it.select_items("words", 0), " ").alias("first_word"),
        F.array_join(it.select_items("words", slice(3, 9)), " ").alias("some_words"),
    )


@query("b04_project_fields", f"with {ITEMS} select doc_idx, {flat_sql('status', 'target')} from fx_items")
def b04(spark, sf):
    return flat(fx.record_items(spark, sf).select(DOC, "status", "target"), "status", "target")


@query("b05_copy_field", f"with {ITEMS} select doc_idx, {flat_sql('brands')}, array_to_string(brands, '|') as brands_copy from fx_items")
def b05(spark, sf):
    return flat(fx.record_items(spark, sf).withColumn("brands_copy", F.col("brands")), "brands", "brands_copy")


@query("b06_concat_fields", f"with {ITEMS} select doc_idx, case when len(target)+len(status)>0 then array_to_string(target || status || target, '|') end as joined from fx_items")
def b06(spark, sf):
    joined = it.concat_fields("target", "status", "target")
    return fx.record_items(spark, sf).select(DOC, F.array_join(joined, "|").alias("joined"))


@query("b07_non_empty", f"""with {ITEMS}, {DOCS}, d as (select doc_idx, {fx.words_sql('fulltext')} as words from fx_docs)
select i.doc_idx, array_to_string(target, '|') as target from fx_items i join d using (doc_idx) where len(target)>0 and len(words)>0""")
def b07(spark, sf):
    d = files.tokens(fx.docs(spark, sf)).select(DOC, "words")
    return flat(filters.non_empty(fx.record_items(spark, sf).join(d, DOC), "target", "words"), "target")


@query("b08_empty", f"with {ITEMS} select doc_idx, {flat_sql('status')} from fx_items where len(target)=0")
def b08(spark, sf):
    return flat(filters.empty(fx.record_items(spark, sf), "target"), "status")


@query("b09_match_items", rf"""with {ITEMS}, m as (select doc_idx, list_filter(brands, lambda x: regexp_matches(x, '\A(?:Brand#[12]|[A-Z]rand#3)')) as brands from fx_items)
select doc_idx, {flat_sql('brands')} from m where len(brands)>0""")
def b09(spark, sf):
    df = filters.keep_matching_items(fx.record_items(spark, sf), {"brands": "Brand#[12]|[A-Z]rand#3"})
    return flat(filters.non_empty(df, "brands"), "brands")


B10 = f"""with {ITEMS},
o1 as (select doc_idx, unnest(brands) as item, generate_subscripts(brands, 1) as pos from fx_items),
k1 as (select doc_idx, list(item order by pos) as brands from (
  select *, row_number() over (partition by item order by doc_idx, pos) as rk from o1) where rk <= 300 group by doc_idx),
d1 as (select f.doc_idx, k1.brands, f.types from fx_items f left join k1 using (doc_idx) where len(f.brands)=0 or k1.brands is not null),
n2 as (select item, floor(count(*)*0.4+0.5) as quota from (select unnest(types) as item from fx_items) group by item),
o2 as (select doc_idx, unnest(types) as item, generate_subscripts(types, 1) as pos from d1),
k2 as (select doc_idx, list(o.item order by pos) as types from (
  select *, row_number() over (partition by item order by doc_idx, pos) as rk from o2) o join n2 using (item) where rk <= quota group by doc_idx),
d2 as (select d1.doc_idx, d1.brands, k2.types from d1 left join k2 using (doc_idx) where len(d1.types)=0 or k2.types is not null)"""


@query("b10_max_per_item", B10 + f" select doc_idx, {flat_sql('brands', 'types')} from d2")
def b10(spark, sf):
    df = filters.max_per_item(fx.record_items(spark, sf), {"brands": 300, "types": 0.4}, block_rows=4096)
    return flat(df, "brands", "types")


B11 = """,
n3 as (select item, count(*) as n from (select unnest(brands) as item from d2) group by item),
o3 as (select doc_idx, unnest(brands) as item, generate_subscripts(brands, 1) as pos from d2),
k3 as (select doc_idx, list(o.item order by pos) as brands from o3 o join n3 using (item) where n >= 100 group by doc_idx),
d3 as (select d2.doc_idx, k3.brands, d2.types from d2 left join k3 using (doc_idx) where len(d2.brands)=0 or k3.brands is not null)"""


@query("b11_min_per_item", B10.replace("rk <= 300", "rk <= 120") + B11 + f" select doc_idx, {flat_sql('brands', 'types')} from d3")
def b11(spark, sf):
    df = filters.max_per_item(fx.record_items(spark, sf), {"brands": 120, "types": 0.4}, block_rows=4096)
    return flat(filters.min_per_item(df, {"brands": 100}), "brands", "types")


@query("b12_target", f"with {ITEMS} select doc_idx, coalesce(brands[1], '') as target from fx_items")
def b12(spark, sf):
    return fx.record_items(spark, sf).select(DOC, F.coalesce(it.first_item("brands"), F.lit("")).alias("target"))


@query("b14_skip_empty", f"""with {ITEMS} select doc_idx, 'target' as kind, array_to_string(target, '|') as items from fx_items where len(target)>0
union all select doc_idx, 'status', array_to_string(status, '|') from fx_items where len(status)>0""")
def b14(spark, sf):
    df = fx.record_items(spark, sf)
    kinds = [
        filters.without_empty(df, k).select(DOC, F.lit(k).alias("kind"), F.array_join(k, "|").alias("items"))
        for k in ("target", "status")
    ]
    return kinds[0].unionByName(kinds[1])


@query("b18_shuffle", f"with {DOCS} select doc_idx, target, {fx.key_sql('doc_idx', seed=7)} as shuffle_key from fx_docs")
def b18(spark, sf):
    return filters.shuffle_documents(fx.docs(spark, sf).select(DOC, "target"), seed=7)


@query("d01_items_per_field", B10 + " " + " union all ".join(FIELD_COUNTS.format(t="d2").split(" union all ")[2:]))
def d01(spark, sf):
    df = filters.max_per_item(fx.record_items(spark, sf), {"brands": 300, "types": 0.4}, block_rows=4096)
    return counts.items_per_field(df, ["brands", "types"])


@query("d02_items_unfiltered", f"with {ITEMS} " + FIELD_COUNTS.format(t="fx_items"))
def d02(spark, sf):
    return counts.items_per_field(fx.record_items(spark, sf), FIELDS)


@query("d03_documents_per_target", f"with {DOCS} select target, count(*) as n_docs from fx_docs group by target")
def d03(spark, sf):
    return counts.descending(counts.documents_per_target(fx.docs(spark, sf)))


@query("d04_document_count", f"with {ITEMS} select count(*) as n_docs from fx_items where len(target)>0")
def d04(spark, sf):
    return filters.non_empty(fx.record_items(spark, sf), "target").agg(F.count(F.lit(1)).alias("n_docs"))


@query("d05_distinct_targets", f"""with {fx.PRED_SQL} select count(*) as n_docs, count(distinct target) as n_targets,
count(distinct nullif(predicted, '')) as n_predicted from fx_pred""")
def d05(spark, sf):
    return counts.target_summary(fx.predictions(spark, sf))


@query("e03_descending_listing", f"""with {ITEMS} select item, count(*) as n, row_number() over (order by count(*) desc, item) as place
from (select unnest(brands) as item from fx_items) group by item""")
def e03(spark, sf):
    listed = counts.items_per_field(fx.record_items(spark, sf), ["brands"]).select("item", "n")
    # the place shows the order, which an unordered comparison would not see
    ranked = dense_index(listed.withColumn("neg", -F.col("n")), ["neg", "item"], "place")
    return ranked.select("item", "n", (F.col("place") + 1).alias("place"))


TARGETS = f"""with {DOCS}, {RECORDS}, i as (
select d.doc_idx, d.target, {fx.items_sql('r.brands')} as brands from fx_docs d join fx_records r using (doc_idx) where d.quality is not null),
o as (select doc_idx, unnest(brands) as item, generate_subscripts(brands, 1) as pos from i),
k as (select doc_idx, list(item order by pos) as brands from (select *, row_number() over (partition by item order by doc_idx, pos) as rk from o) where rk<=20 group by doc_idx),
d as (select i.doc_idx, i.target, k.brands from i join k using (doc_idx)),
n as (select item, count(*) as n from (select unnest(brands) as item from d) group by item),
m as (select distinct doc_idx from (select doc_idx, unnest(brands) as item from d) join n using (item) where n>=5)
select target, count(*) as n_docs from d join m using (doc_idx) group by target"""


@query("j02_target_counts", TARGETS)
def target_counts(spark, sf):
    d = fx.docs(spark, sf).filter(F.col("quality").isNotNull()).select(DOC, "target")
    r = fx.records(spark, sf).select(DOC, it.split_items("brands").alias("brands"))
    df = commands.select_documents(d.join(r, DOC), max_per_item={"brands": 20}, min_per_item={"brands": 5})
    return counts.descending(counts.documents_per_target(df))
