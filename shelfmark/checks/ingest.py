"""Queries over the multi-source merge and the export jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import fixtures as fx
from shelfmark.checks.registry import query
from shelfmark.functions import items as it
from shelfmark.functions.items import SPACE_CLASS
from shelfmark.operators import merge
from shelfmark.plans import ingest
from shelfmark.session import scratch_path
from shelfmark.sources import digital_library, files, marc, relational, sinks

SOURCES, HIER, PAGES, MARC = fx.SOURCES_SQL, fx.HIER_SQL, fx.PAGES_SQL, fx.MARC_SQL
FIELDS = fx.SOURCE_FIELDS

ITEM_ROWS = f"""with {SOURCES}, {HIER}, f as (
select id, priority, source_no, line_no, '072' as field, "072" as v from fx_sources union all select id, priority, source_no, line_no, '650', "650" from fx_sources
union all select id, priority, source_no, line_no, '653', "653" from fx_sources),
i as (select id, field, priority, unnest(v) as value, generate_subscripts(v,1)-1 as position from (select id, field, priority, {fx.items_sql('v')} as v from f)),
u as (select id, field, value, -np as priority, min(position) as position from (select *, min(-priority) over (partition by id, field, value) as np from i) where -np=priority group by id, field, value, np),
s1 as (select id, '008' as field, unnest(v) as value, priority, generate_subscripts(v,1)-1 as position from (select id, priority, {fx.items_sql('v')} as v from (
  select id, priority, "008" as v, row_number() over (partition by id order by priority desc, source_no, line_no) as rk from fx_sources where "008"<>'') where rk=1)),
m as (select id, field, value, priority, position from u union all select id, field, value, priority, min(position) from s1 group by id, field, value, priority),
vals as (select id, field, string_agg(value, '|' order by priority desc, position, value) as vals from m group by id, field)"""


def long_items(df):
    return df.select("id", "field", "value", F.col("priority").cast("int"), F.col("position").cast("bigint"))


@query("a06_source_scan", f"""with {SOURCES} select id, source, priority, "008", "072", "650", "653" from fx_sources where line_no%10<>9""")
def a06(spark, sf):
    rows = fx.sources(spark, sf)
    folder = scratch_path(spark, "sources")
    kinds = [r[0] for r in rows.select("source").distinct().collect()]  # the source names, one per file
    cells = [F.col(f"`{f}`") if f in FIELDS else F.lit("") for f in merge.MARC_FIELDS]
    full = F.concat_ws("\t", "id", *[F.coalesce(c, F.lit("")) for c in cells], F.lit("extra column"))
    line = F.when(F.col("line_no") % 10 == 9, F.concat_ws("\t", "id", F.lit("short"))).otherwise(full)
    rows.orderBy("line_no").select("source", line.alias("value")).write.partitionBy("source").text(folder)
    rank = {"purchase": 2, "click": 1}
    catalogue = [{"name": k, "priority": rank.get(k, 0), "file": f"{folder}/source={k}"} for k in sorted(kinds)]
    catalogue.append({"name": "gone", "priority": 5, "file": f"{folder}/source=gone"})
    df = files.scan_sources(spark, catalogue)
    return df.select("id", "source", F.col("priority").cast("int"), *[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) for f in FIELDS])


@query("a07_hierarchy_scan", f"with {HIER} select category, path from fx_hier")
def a07(spark, sf):
    path = scratch_path(spark, "hier.tsv")
    old = fx.hierarchy(spark, sf).select(F.lit(0).alias("o"), F.concat_ws("\t", "category", F.lit("old"), F.lit("path")).alias("value"))
    name = F.concat(F.lit(" "), F.upper("category"), F.lit(" "))
    new = fx.hierarchy(spark, sf).select(F.lit(1).alias("o"), F.concat_ws("\t", name, F.replace("path", F.lit("->"), F.lit("\t"))).alias("value"))
    old.unionByName(new).orderBy("o", "value").select("value").write.text(path)
    return files.scan_hierarchy(spark, path)


STITCHED = f"""with {PAGES}, r as (select group_id, record_id, string_agg(regexp_replace(regexp_replace(text, '-\\r?\\n', '', 'g'), '\\r?\\n', ' ', 'g'), ' ' order by page_no) as text
from fx_pages group by group_id, record_id), g as (select group_id, string_agg(text, ' ' order by record_id) as text from r group by group_id)"""


@query("a08_text_folder", f"""with {PAGES} select cast(record_id as varchar) || '_' || cast(page_no as varchar) as id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {fx.strip_sql('x')}), ' ') as fulltext from fx_pages where length(text)>0""")
def a08(spark, sf):
    folder = scratch_path(spark, "texts")
    rows = fx.pages(spark, sf).select(F.concat_ws("_", "record_id", "page_no").alias("page"), "text")
    sinks.write_text_folder(rows, folder, "page", "text")
    return files.scan_text_folder(spark, folder, r"~([^/]*)\.txt$")


RELATIONS = f"""with {PAGES}, ft as (select * from fx_pages), rec as (select distinct record_id, group_id from fx_pages where record_id%9<>4)"""


def _relations(spark, sf):
    pages = fx.pages(spark, sf)
    fulltext = pages.select(
        F.col("record_id").alias("harvested_record_id"), F.col("page_no").alias("order_in_document"),
        F.encode("text", "UTF-8").alias("fulltext"),
    )
    harvested = pages.filter("record_id % 9 <> 4").select(
        F.col("record_id").alias("id"), F.col("group_id").alias("dedup_record_id")
    ).distinct()
    return fulltext, harvested


@query("a09_relational_source", RELATIONS + " select ft.record_id, rec.group_id, page_no, text from ft join rec using (record_id)")
def a09(spark, sf):
    fulltext, harvested = _relations(spark, sf)
    return merge.with_group(relational.record_pages(fulltext), relational.record_groups(harvested))


def library_xml(spark, sf):
    """Documents and pages of a digital library, made from the conversations: a page per turn, a text line per line."""
    word = rf'[^{SPACE_CLASS}"<>]+'
    turns = fx.table(spark, sf, "conversations")
    page_id = F.concat_ws("-", F.lit("uuid:p"), "conv_id", "turn")
    string = lambda w: F.concat(F.lit('<String CONTENT="'), w, F.lit('"/>'))
    marked = lambda i: (i == 0) & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    line = lambda l, i: F.concat(
        F.lit('<TextLine ID="x">'), F.array_join(F.transform(F.regexp_extract_all(l, F.lit(word), F.lit(0)), string), ""),
        F.when(marked(i), string(F.lit("172"))).otherwise(F.lit("")), F.lit("</TextLine>"),
    )
    xml = F.concat(F.lit("<alto>"), F.array_join(F.transform(F.split("text", "\n", -1), line), ""), F.lit("</alto>"))
    pages = turns.select(page_id.alias("page_id"), xml.alias("xml"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page_id.alias("p")))).alias("_p"))
    ref = lambda p: F.concat(F.lit('<hasPage rdf:resource="info:fedora/'), p, F.lit('"/>'))
    gone = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("uuid:gone"))).otherwise(it.no_items())
    refs = F.array_join(F.transform(F.concat(F.col("_p.p"), gone), ref), "\n")
    doc = F.concat(
        F.lit("<rdf><dc:title>Talk "), F.col("conv_id").cast("string"), F.lit("</dc:title>\n<dc:creator>A</dc:creator><dc:creator>B</dc:creator>\n<dc:language>cze</dc:language>\n"),
        refs, F.lit("</rdf>"),
    )
    return listed.select(F.col("conv_id").alias("doc_id"), doc.alias("xml")), pages


LIBRARY = rf"""with t as (select conv_id as doc_id, 'uuid:p-'||conv_id||'-'||turn as page_id, row_number() over (partition by conv_id order by turn)-1 as page_no,
  (conv_id+turn)%3=0 as marked, list_transform(string_split(text, chr(10)), lambda l: regexp_extract_all(l, '[^{SPACE_CLASS}"<>]+')) as lines from conversations),
refs as (select doc_id, page_no, page_id from t union all select doc_id, count(*), 'uuid:gone' from t where doc_id%7=0 group by doc_id),
head as (select doc_id, page_no, page_id, '<page>'||chr(10)||'<meta_page> <num>'||page_no||'</num> <source>'||page_id||'</source> </meta_page>'||chr(10) as h from refs),
body as (select h.doc_id, h.page_no, case when lines is null then h||'<error>'||chr(10) else
   (case when marked and len(lines[1])=0 then h[1:-2] when marked then h||array_to_string(lines[1], chr(10)) else h||array_to_string(list_transform(lines[1], lambda w: w||chr(10)),'') end)
   || array_to_string(list_transform(flatten(lines[2:]), lambda w: w||chr(10)),'') end || '</page>'||chr(10) as chunk
   from head h left join t using (page_id)),
chunks as (select * from body union all select doc_id, -1, '<doc>'||chr(10)||'<meta_doc> <title>Talk '||doc_id||'</title> <creator>A</creator> <creator>B</creator> <language>cze</language> </meta_doc>'||chr(10) from (select distinct doc_id from t)
union all select doc_id, count(*), '</doc>'||chr(10) from refs group by doc_id)"""


@query("a10_library_source", LIBRARY + " select refs.doc_id, cast(refs.page_no as bigint) as page_no, refs.page_id, coalesce(len(flatten(lines))+(case when marked then 1 else 0 end), -1) as n_words from refs left join t using (page_id)")
def a10(spark, sf):
    documents, pages = library_xml(spark, sf)
    refs = digital_library.page_references(documents)
    words = pages.select("page_id", F.size(F.flatten(digital_library.page_lines())).cast("bigint").alias("n_words"))
    return refs.join(words, "page_id", "left").select(
        "doc_id", F.col("page_no").cast("bigint"), "page_id", F.coalesce("n_words", F.lit(-1)).alias("n_words")
    )


@query("a20_vertical_text", LIBRARY + " select doc_id, cast(page_no as bigint) as page_no, chunk from chunks")
def a20(spark, sf):
    df = digital_library.vertical_text(*library_xml(spark, sf))
    return df.withColumn("page_no", F.col("page_no").cast("bigint"))


@query("g23_dublin_core", "select conv_id as doc_id, 'Talk '||conv_id as title, 'A|B' as creator, 'cze' as language, '' as publisher from conversations group by conv_id")
def g23(spark, sf):
    documents, _ = library_xml(spark, sf)
    cells = {n: c for n, c in zip(digital_library.DUBLIN_CORE, digital_library.dublin_core())}
    return documents.select("doc_id", *[F.array_join(cells[n], "|").alias(n) for n in ("title", "creator", "language", "publisher")])


@query("j11_library_conversion", LIBRARY + ", lines as (select doc_id, unnest(string_split(rtrim(chunk, chr(10)), chr(10))) as line from chunks) select line, count(*) as n from lines group by line")
def j11(spark, sf):
    chunks, _ = ingest.convert_library(*library_xml(spark, sf))
    path = scratch_path(spark, "vertical.txt")
    sinks.write_vertical(chunks, path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


MARC_VALUES = f"""with {MARC}, ok as (select * from fx_marc where raw_record not like '%broken'),
v as (select id, dedup_record_id, import_conf_id, '008' as field, 0 as pos, regexp_extract(raw_record, 'tag="008">([^<]*)<', 1) as value from ok
union all select id, dedup_record_id, import_conf_id, '650', 1, regexp_extract(raw_record, 'tag="650".*?code="a">([^<]*)<', 1)||' '||regexp_extract(raw_record, 'code="x">([^<]*)<', 1) from ok where raw_record not like '%ind2="9"><marc:subfield code="a">T%ind2="9"%' and raw_record like '%tag="650" ind2=" "%'
union all select id, dedup_record_id, import_conf_id, '245', 2 - cast(raw_record like '%tag="650" ind2="9"%' as int), 'T '||id from ok)"""


@query("a11_marc_source", MARC_VALUES + " select id, field, value from v")
def a11(spark, sf):
    parsed = marc.parse_records(fx.marc(spark, sf))
    return marc.field_values(parsed, ["id"]).select("id", "field", "value")


@query("b19_subfield_rules", MARC_VALUES + " select field, count(*) as n, sum(length(value)) as n_chars from v group by field")
def b19(spark, sf):
    values = marc.field_values(marc.parse_records(fx.marc(spark, sf)), ["id"])
    return values.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("n_chars"))


EXPORTED = MARC_VALUES + """, lib as (select (import_conf_id*10) as library_id, * from v where import_conf_id<>3),
x as (select library_id, dedup_record_id as id, coalesce(string_agg(value, ' $|$ ' order by v.id, pos) filter (where field='008'),'') as "008",
 coalesce(string_agg(value, ' $|$ ' order by v.id, pos) filter (where field='650'),'') as "650", coalesce(string_agg(value, ' $|$ ' order by v.id, pos) filter (where field='245'),'') as "245"
 from lib v group by library_id, dedup_record_id)"""


def _export(spark, sf, **options):
    records = fx.marc(spark, sf)
    conf = records.filter("import_conf_id <> 3").select(
        F.col("import_conf_id").alias("id"), (F.col("import_conf_id") * 10).alias("library_id")
    ).distinct()
    return ingest.export_metadata(records, conf, **options)


@query("d08_collect_marc_values", EXPORTED + ' select library_id, id, "008", "650", "245" from x')
def d08(spark, sf):
    return _export(spark, sf).select("library_id", "id", "008", "650", "245")


@query("c06_library_lookup", f"with {MARC} select id, import_conf_id*10 as library_id from fx_marc where import_conf_id<>3")
def c06(spark, sf):
    records = fx.marc(spark, sf)
    conf = records.filter("import_conf_id <> 3").select("import_conf_id", (F.col("import_conf_id") * 10).alias("library_id")).distinct()
    return records.join(conf, "import_conf_id").select("id", "library_id")


LINES = EXPORTED + """ select library_id, id||chr(9)||"008"||repeat(chr(9),9)||"650"||repeat(chr(9),8)||"245" as line from x"""


@query("a18_library_sink", LINES.replace("select library_id,", "select cast(library_id as bigint) as library_id,").replace("x as (select cast(library_id as bigint) as library_id,", "x as (select library_id,"))
def a18(spark, sf):
    path = scratch_path(spark, "libraries")
    sinks.write_libraries(_export(spark, sf), path, list(merge.MARC_FIELDS))
    return spark.read.text(path).select(F.col("library_id").cast("bigint").alias("library_id"), F.col("value").alias("line"))


@query("j10_metadata_export", EXPORTED.replace("where import_conf_id<>3)", "where import_conf_id<>3 and (import_conf_id, dedup_record_id, v.id) in (select import_conf_id, dedup_record_id, max(id) from ok where dedup_record_id<>2 group by 1,2))") + ' select library_id, id, "008", "650", "245" from x')
def j10(spark, sf):
    dedup = fx.marc(spark, sf).filter("dedup_record_id <> 2").select(F.col("dedup_record_id").alias("id")).distinct()
    return _export(spark, sf, dedup=dedup, last_only=True).select("library_id", "id", "008", "650", "245")


@query("f01_union_sources", f"with {SOURCES} select source, priority, source_no, count(*) as n from fx_sources group by all")
def f01(spark, sf):
    rows = fx.sources(spark, sf).drop("priority", "source_no")
    parts = [
        (rows.filter("source = 'purchase'"), 2), (rows.filter("source = 'click'"), 1),
        (rows.filter("source not in ('purchase', 'click')"), 0),
    ]
    return merge.union_sources(parts).groupBy("source", "priority", "source_no").agg(F.count(F.lit(1)).alias("n"))


@query("d09_item_union", ITEM_ROWS + " select id, field, value, priority, position from u")
def d09(spark, sf):
    return long_items(merge.unite_items(merge.record_items(fx.sources(spark, sf), ["072", "650", "653"])))


@query("f02_item_set_union", ITEM_ROWS + " select id, field, count(*) as n from u group by id, field")
def f02(spark, sf):
    united = merge.unite_items(merge.record_items(fx.sources(spark, sf), ["072", "650", "653"]))
    return united.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"))


@query("c01_record_merge", ITEM_ROWS + " select id, field, vals from vals")
def c01(spark, sf):
    merged = merge.merge_records(fx.sources(spark, sf), FIELDS)
    return merge.ordered_values(merged).select("id", "field", F.array_join("values", "|").alias("vals"))


TEXTS = f""", {PAGES}, tx as (select cast(record_id as varchar) as id, string_agg(regexp_replace(regexp_replace(text, '-\\r?\\n', '', 'g'), '\\r?\\n', ' ', 'g'), ' ' order by page_no) as fulltext from fx_pages group by record_id)"""


def texts(spark, sf):
    own = fx.pages(spark, sf).withColumn("group_id", F.col("record_id"))  # every record is a group of its own
    whole = merge.stitch_groups(merge.stitch_parts(own, 2))
    return whole.select(F.col("group_id").cast("string").alias("id"), F.col("text").alias("fulltext"))


@query("c02_records_with_content", f"with {SOURCES}{TEXTS} select id, line_no from fx_sources where id in (select id from tx where fulltext<>'')")
def c02(spark, sf):
    return merge.with_content(fx.sources(spark, sf), texts(spark, sf)).select("id", "line_no")


@query("c03_attach_text", f"with {SOURCES}{TEXTS} select s.id, coalesce(fulltext,'') as fulltext from (select distinct id from fx_sources) s left join tx using (id)")
def c03(spark, sf):
    return merge.attach_text(fx.sources(spark, sf).select("id").distinct(), texts(spark, sf), allow_empty=True)


@query("c04_hierarchy_lookup", ITEM_ROWS + f", k as (select id, lower({fx.strip_sql('value')}) as category from u where field='653') select id, category, path as value, 'mapped' as state from k join fx_hier using (category) union all select '', category, cast(count(*) as varchar), 'unmapped' from k where category not in (select category from fx_hier) group by category")
def c04(spark, sf):
    items = merge.unite_items(merge.record_items(fx.sources(spark, sf), ["653"]))
    tree = fx.hierarchy(spark, sf)
    kept = items.withColumn("category", F.lower("value"))
    mapped = merge.map_to_hierarchy(items, tree).select("id", F.lower(F.element_at(F.split("value", "->"), -1)).alias("category"), "value", F.lit("mapped").alias("state"))
    missing = merge.unmapped(items, tree).select(F.lit("").alias("id"), "category", F.col("n").cast("string").alias("value"), F.lit("unmapped").alias("state"))
    return mapped.unionByName(missing)


@query("c05_record_groups", RELATIONS + ", r as (select distinct record_id from ft) select record_id, coalesce(group_id, -1) as group_id from r left join rec using (record_id)")
def c05(spark, sf):
    fulltext, harvested = _relations(spark, sf)
    pages, groups = relational.record_pages(fulltext), relational.record_groups(harvested)
    found = merge.with_group(pages.select("record_id").distinct(), groups)
    missing = merge.without_group(pages, groups).withColumn("group_id", F.lit(-1).cast("bigint"))
    return found.unionByName(missing)


@query("d07_stitch_pages", STITCHED + " select group_id, text from g")
def d07(spark, sf):
    return merge.stitch_groups(merge.stitch_parts(fx.pages(spark, sf), 2))


@query("f03_distinct_records", f"with {PAGES} select distinct record_id from fx_pages")
def f03(spark, sf):
    return fx.pages(spark, sf).select("record_id").distinct()


@query("j09_text_export", STITCHED.replace("from fx_pages group by", "from fx_pages where record_id%9<>4 group by") + " select group_id, text from g")
def j09(spark, sf):
    return ingest.export_texts(*_relations(spark, sf))


LEMMA_LEXICON = ", lex as (select distinct lower(n_name) as form, lower(substr(n_name,1,4)) as lemma from nation union select distinct event_type, substr(event_type,1,4) from events)"
LEMMAS = LEMMA_LEXICON + """, lw as (select id, field, priority, position, value, regexp_extract_all(regexp_replace(value, '[^\\p{L}\\p{M}\\p{N}_]', ' ', 'g'), '[^ ]+') as w from u where field in ('072','653')),
lx as (select id, field, priority, position, value, unnest(w) as form, generate_subscripts(w,1) as pos from lw),
ll as (select id, field, priority, position, string_agg(coalesce(lemma, lx.form), ' ' order by pos) as value from lx left join lex on lx.form=lex.form group by id, field, priority, position, lx.value),
lu as (select id, field, value, -np as priority, min(position) as position from (select *, min(-priority) over (partition by id, field, value) as np from ll) where -np=priority group by id, field, value, np)"""


def item_lexicon(spark, sf):
    nation, events = fx.table(spark, sf, "nation"), fx.table(spark, sf, "events")
    name = F.lower("n_name")
    return nation.select(name.alias("form"), F.substring(name, 1, 4).alias("lemma")).unionByName(
        events.select(F.col("event_type").alias("form"), F.substring("event_type", 1, 4).alias("lemma"))
    ).distinct()


@query("g22_lemmatise_items", ITEM_ROWS + LEMMAS + " select id, field, value, priority, position from lu")
def g22(spark, sf):
    united = merge.unite_items(merge.record_items(fx.sources(spark, sf), ["072", "653"]))
    return long_items(merge.lemmatise_items(united, item_lexicon(spark, sf)))


MERGED = (
    ITEM_ROWS.replace("fx_sources as (", "fx_sources_all as (", 1).replace(f", {HIER}", f", {HIER}{TEXTS}, fx_sources as (select * from fx_sources_all where id in (select id from tx where fulltext<>''))", 1)
    + LEMMAS
    + """, hm as (select id, '653h' as field, path as value, priority, position from u join fx_hier on lower(trim(value))=category where field='653'),
hu as (select id, field, value, max(priority) as priority, min(position) as position from hm group by id, field, value),
al as (select id, field, value, priority, position from m union all select * from hu union all select id, field||'_lemm', value, priority, position from lu where field='653'),
av as (select id, field, string_agg(value, '$|$' order by priority desc, position, value) as v from al group by id, field)
select s.id, """
    + ", ".join(f"""coalesce(max(v) filter (where field='{c}'),'') as "{c}\"""" for c in ("008", "072", "650", "653", "653h", "653_lemm"))
    + ", any_value(fulltext) as fulltext from (select distinct id from fx_sources) s join tx using (id) left join av using (id) group by s.id"
)


def _merged(spark, sf):
    return ingest.merge_sources(
        fx.sources(spark, sf), texts(spark, sf), fields=FIELDS, target_field="653", hierarchy=fx.hierarchy(spark, sf),
        hierarchy_field="653h", lexicon=item_lexicon(spark, sf), lemmatised_fields=["653"],
    )


@query("j08_multi_source_merge", MERGED)
def j08(spark, sf):
    return _merged(spark, sf)


@query("a19_merged_sink", MERGED.replace(", any_value(fulltext) as fulltext", ""))
def a19(spark, sf):
    path = scratch_path(spark, "merged.csv")
    sinks.write_merged(_merged(spark, sf).drop("fulltext"), path)
    df = files.scan_metadata(spark, path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
