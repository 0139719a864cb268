"""Views over the given tables that serve as input of the registered queries, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import items as it
from shelfmark.functions.items import SPACE_CLASS
from shelfmark.functions.text import WORD_CHARS
from shelfmark.operators.skew import DOC, exploded


# tables with large rows, whose work per row is worth spreading when the file is a single split
HEAVY = ("documents", "conversations", "embeddings", "pages")

# lines that one task sorts and gathers per order, where the session's partitions would hold more
LINES_PER_TASK = 1 << 19


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. A heavy table that comes in fewer splits than there are cores is spread over them."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name not in HEAVY:
        return df
    cores = spark.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def strip_sql(e: str) -> str:
    return rf"regexp_replace({e}, '\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z', '', 'g')"


def items_sql(e: str) -> str:
    return (
        f"(case when {e} is null or {e} = '' then cast([] as varchar[]) "
        f"else list_transform(string_split({e}, '$|$'), lambda it: {strip_sql('it')}) end)"
    )


def words_sql(e: str) -> str:
    return f"regexp_extract_all({e}, '[^{SPACE_CLASS}]+')"


def tokens_sql(e: str) -> str:
    return f"regexp_extract_all({e}, '[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CLASS}]')"


def key_sql(*columns: str, seed: int = 0) -> str:
    parts = " || ':' || ".join(f"cast({c} as varchar)" for c in columns)
    return f"cast('0x' || substr(md5('{seed}' || ':' || {parts}), 1, 15) as bigint)"


# -- records -------------------------------------------------------------------------------------------------------
RECORDS_SQL = """fx_records as (
select o_orderkey as doc_idx, case when o_orderkey%10=0 then null else o_orderpriority end as target,
       o_orderstatus as status,
       string_agg(p_brand, ' $|$ ' order by l_linenumber, l_partkey, l_suppkey) as brands,
       string_agg(p_type, ' $|$ ' order by l_linenumber, l_partkey, l_suppkey) as types
from orders join lineitem on o_orderkey=l_orderkey join part on l_partkey=p_partkey
group by o_orderkey, o_orderpriority, o_orderstatus)"""

RECORD_FIELDS = ["target", "status", "brands", "types"]


def records(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    tasks = lines.count() // LINES_PER_TASK + 1  # without a filter the count comes from the files' footers
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        joined = joined.repartition(tasks, "l_orderkey")
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_type")
    per_order = (
        joined.groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(entry)).alias("_l"))
        .select("l_orderkey", *[F.array_join(f"_l.{c}", " $|$ ").alias(n) for c, n in (("p_brand", "brands"), ("p_type", "types"))])
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    target = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority"))
    return orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias(DOC),
        target.alias("target"),
        F.col("o_orderstatus").alias("status"),
        "brands",
        "types",
    )


RECORD_ITEMS_SQL = RECORDS_SQL + f""", fx_items as (
select doc_idx, {items_sql('target')} as target, {items_sql('status')} as status,
       {items_sql('brands')} as brands, {items_sql('types')} as types from fx_records)"""


def record_items(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select(DOC, *[it.split_items(f).alias(f) for f in RECORD_FIELDS])


# -- documents -----------------------------------------------------------------------------------------------------
DOCS_SQL = """fx_docs as (
select d.doc_id as doc_idx, d.text as fulltext, d.lang as target, d.lang||'->'||d.source as hier,
       cast(l.quality as varchar) as quality
from documents d left join labels l using (doc_id))"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias(DOC),
        F.col("text").alias("fulltext"),
        F.col("lang").alias("target"),
        F.concat_ws("->", "lang", "source").alias("hier"),
        F.col("quality").cast("string").alias("quality"),
    )


# -- predictions ---------------------------------------------------------------------------------------------------
PRED_SQL = """fx_pred as (
select doc_id as doc_idx, doc_id%3 as fold, lang||'->'||source as target,
       case doc_id%7 when 0 then '' when 1 then lang||'->src0' when 2 then lang when 3 then 'xx->'||source
       else lang||'->'||source end as predicted
from documents)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    seven = F.col("doc_id") % 7
    full = F.concat_ws("->", "lang", "source")
    predicted = (
        F.when(seven == 0, F.lit(""))
        .when(seven == 1, F.concat("lang", F.lit("->src0")))
        .when(seven == 2, F.col("lang"))
        .when(seven == 3, F.concat(F.lit("xx->"), "source"))
        .otherwise(full)
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias(DOC), (F.col("doc_id") % 3).alias("fold"), full.alias("target"), predicted.alias("predicted")
    )


# -- scores --------------------------------------------------------------------------------------------------------
SCORES_SQL = """fx_scores as (
select d.doc_id as doc_idx, c.i as classifier_id, t.lang as target,
       ((d.doc_id*31+c.i*17+ascii(t.lang)*7+d.doc_id*c.i*ascii(substr(t.lang,2,1)))%101)/100.0::double as confidence
from documents d, (select unnest([0,1,2]) i) c, (select unnest(['de','en','es','fr']) lang) t
where (d.doc_id+c.i)%5<>0)"""

LANGS = ["de", "en", "es", "fr"]


def scores(spark: SparkSession, sf: str) -> DataFrame:
    d, c, t = F.col(DOC), F.col("classifier_id"), F.col("target")
    value = (d * 31 + c * 17 + F.ascii(t) * 7 + d * c * F.ascii(F.substring(t, 2, 1))) % 101
    return (
        table(spark, sf, "documents")
        .select(F.col("doc_id").alias(DOC), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("classifier_id"))
        .filter((d + c) % 5 != 0)
        .withColumn("target", F.explode(F.array(*map(F.lit, LANGS))))
        .withColumn("confidence", value / F.lit(100.0))
    )


WEIGHTS_SQL = """fx_weights as (
select c.i as classifier_id, t.lang as target, case when t.lang='es' then 0.0 else ((c.i*3+ascii(t.lang))%7)/10.0 end::double as weight
from (select unnest([0,1,2]) i) c, (select unnest(['de','en','es','fr']) lang) t)"""


def weights(spark: SparkSession) -> DataFrame:
    c, t = F.col("classifier_id"), F.col("target")
    value = F.when(t == "es", F.lit(0.0)).otherwise(((c * 3 + F.ascii(t)) % 7) / F.lit(10.0))
    return (
        spark.range(3)
        .select(F.col("id").cast("int").alias("classifier_id"))
        .withColumn("target", F.explode(F.array(*map(F.lit, LANGS))))
        .withColumn("weight", value)
    )


# -- sources -------------------------------------------------------------------------------------------------------
SOURCES_SQL = """fx_sources as (
select cast(user_id as varchar) as id, event_type as source, event_id as line_no,
       case event_type when 'purchase' then 2 when 'click' then 1 else 0 end as priority,
       case event_type when 'purchase' then 0 when 'click' then 1 else 2 end as source_no,
       case when event_id%4=0 then '' else props end as "008",
       cast(cast(floor(value) as bigint)%20 as varchar) || ' $|$ ' || cast(cast(floor(value*10) as bigint)%20 as varchar) as "650",
       case when event_id%3=0 then '' else event_type || ' $|$ ' || cast(event_id%5 as varchar) end as "072",
       ' ' || coalesce(n_name, 'Nowhere ' || cast(event_id%3 as varchar)) as "653"
from events left join nation on n_nationkey=event_id%30)"""

SOURCE_FIELDS = ["008", "072", "650", "653"]


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Record lines: one per event; the user is the record id, the event type tells source and priority."""
    kind, number = F.col("event_type"), F.col("event_id")
    digits = lambda e: (F.floor(e).cast("bigint") % 20).cast("string")
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("_k"), "n_name")
    nowhere = F.concat(F.lit("Nowhere "), (number % 3).cast("string"))
    events = table(spark, sf, "events").withColumn("_k", number % 30).join(names, "_k", "left")
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        kind.alias("source"),
        number.alias("line_no"),
        F.when(kind == "purchase", 2).when(kind == "click", 1).otherwise(0).alias("priority"),
        F.when(kind == "purchase", 0).when(kind == "click", 1).otherwise(2).alias("source_no"),
        F.when(number % 4 == 0, F.lit("")).otherwise(F.col("props")).alias("008"),
        F.concat_ws(" $|$ ", digits(F.col("value")), digits(F.col("value") * 10)).alias("650"),
        F.when(number % 3 == 0, F.lit(""))
        .otherwise(F.concat_ws(" $|$ ", kind, (number % 5).cast("string")))
        .alias("072"),
        F.concat(F.lit(" "), F.coalesce("n_name", nowhere)).alias("653"),
    )


HIER_SQL = """fx_hier as (
select lower(n_name) as category, r_name||'->'||n_name as path from nation join region on n_regionkey=r_regionkey)"""


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("category"), F.concat_ws("->", "r_name", "n_name").alias("path")
    )


# -- pages ---------------------------------------------------------------------------------------------------------
PAGES_SQL = """fx_pages as (
select conv_id as record_id, conv_id%50 as group_id, turn as page_no,
       replace(text, ' the ', ' th-'||chr(10)||'e ') as text from conversations)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("record_id"),
        (F.col("conv_id") % 50).alias("group_id"),
        F.col("turn").alias("page_no"),
        F.replace("text", F.lit(" the "), F.lit(" th-\ne ")).alias("text"),
    )


# -- MARC ----------------------------------------------------------------------------------------------------------
MARC_SQL = """fx_marc as (
select s_suppkey as id, s_suppkey%7 as dedup_record_id, s_nationkey%4 as import_conf_id,
  case when s_suppkey%11=5 then '<record><broken' else
  '<record xmlns="x"><marc:controlfield tag="008">'||s_name||'</marc:controlfield><marc:datafield tag="650" ind2="'
  ||(case when s_suppkey%3=0 then '9' else ' ' end)||'"><marc:subfield code="a">'||n_name
  ||'</marc:subfield><marc:subfield code="b">skip</marc:subfield><marc:subfield code="x">'||s_nationkey
  ||'</marc:subfield></marc:datafield><marc:datafield tag="245" ind2="9"><marc:subfield code="a">T</marc:subfield><marc:subfield code="b">'
  ||s_suppkey||'</marc:subfield></marc:datafield></record>' end as raw_record
from supplier join nation on s_nationkey=n_nationkey)"""


def marc(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    xml = F.concat(
        F.lit('<record xmlns="x"><marc:controlfield tag="008">'), "s_name",
        F.lit('</marc:controlfield><marc:datafield tag="650" ind2="'),
        F.when(F.col("s_suppkey") % 3 == 0, "9").otherwise(" "),
        F.lit('"><marc:subfield code="a">'), "n_name",
        F.lit('</marc:subfield><marc:subfield code="b">skip</marc:subfield><marc:subfield code="x">'),
        F.col("s_nationkey").cast("string"),
        F.lit('</marc:subfield></marc:datafield><marc:datafield tag="245" ind2="9"><marc:subfield code="a">T</marc:subfield><marc:subfield code="b">'),
        F.col("s_suppkey").cast("string"), F.lit("</marc:subfield></marc:datafield></record>"),
    )
    return joined.select(
        F.col("s_suppkey").alias("id"),
        (F.col("s_suppkey") % 7).alias("dedup_record_id"),
        (F.col("s_nationkey") % 4).alias("import_conf_id"),
        F.when(F.col("s_suppkey") % 11 == 5, F.lit("<record><broken")).otherwise(xml).alias("raw_record"),
    )


# -- lexicon -------------------------------------------------------------------------------------------------------
LEXICON_SQL = """fx_lexicon as (
select distinct w as form, lower(w[1:greatest(1,len(w)-2)]) as lemma, substr('NAPCVDRJTIZX',1+len(w)%12,1) as tag
from (select unnest(regexp_extract_all(text,'[A-Za-z]+')) w from documents) where len(w)%4<>0)"""


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    w = F.col("form")
    return (
        exploded(table(spark, sf, "documents"), [], found, "form").filter(F.length(w) % 4 != 0).distinct()
        .select(
            "form",
            F.lower(F.substring(w, F.lit(1), F.greatest(F.lit(1), F.length(w) - 2))).alias("lemma"),
            F.substring(F.lit("NAPCVDRJTIZX"), F.length(w) % 12 + 1, F.lit(1)).alias("tag"),
        )
    )
