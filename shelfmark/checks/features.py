"""Queries over feature extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import fixtures as fx
from shelfmark.checks.metrics import r9
from shelfmark.checks.registry import query
from shelfmark.functions import text as tx
from shelfmark.operators import features as ft
from shelfmark.operators.embeddings import packed_embeddings, project
from shelfmark.operators.packed import unpacked
from shelfmark.operators.skew import DOC

DOCS, ITEMS = fx.DOCS_SQL, fx.RECORD_ITEMS_SQL
W = fx.words_sql("fulltext")
TEXT = {"fulltext": ("fulltext", "text_ngrams", 1)}

TERMS = f"""with {DOCS}, t as (select doc_idx, unnest(w) as term, generate_subscripts(w,1) as pos from (select doc_idx, {W} as w from fx_docs)),
tf as (select doc_idx, term, cast(count(*) as double) as value from t group by doc_idx, term)"""


def text_terms(spark, sf):
    return ft.analyse_kinds(fx.docs(spark, sf), TEXT)


def text_counts(spark, sf):
    return ft.count_vectors(text_terms(spark, sf))


@query("h01_count_vectors", TERMS + " select doc_idx, 'fulltext' as kind, term, value from tf")
def h01(spark, sf):
    return text_counts(spark, sf)


IDF = """, idf as (select term, ln((1.0 + (select count(distinct doc_idx) from tf)) / (1.0 + count(*))) + 1 as idf from tf group by term),
w as (select doc_idx, term, value*idf as v from tf join idf using (term)),
tfidf as (select doc_idx, term, v/sqrt(sum(v*v) over (partition by doc_idx)) as value from w)"""


def text_tfidf(spark, sf):
    return unpacked(ft.packed_tfidf(text_terms(spark, sf)), (DOC, "kind"))


@query("h02_tfidf", TERMS + IDF + " select doc_idx, 'fulltext' as kind, term, round(value, 9) as value from tfidf")
def h02(spark, sf):
    return r9(text_tfidf(spark, sf)).select(DOC, "kind", "term", "value")


BUCKET = "cast('0x' || substr(md5({t}),1,8) as bigint) % {n}"


@query("h03_hash_vectors", TERMS + f""", b as (select doc_idx, {BUCKET.format(t='term', n=1024)} as term, sum(value) as pos,
sum(value * (1 - 2*({BUCKET.format(t="'sign:'||term", n=2)}))) as signed from tf group by 1,2)
select doc_idx, 'unsigned' as kind, term, round(pos/sqrt(sum(pos*pos) over (partition by doc_idx)), 9) as value from b
union all select doc_idx, 'signed', term, round(signed/sqrt(sum(signed*signed) over (partition by doc_idx)), 9) from b where signed<>0""")
def h03(spark, sf):
    rows = ft.hash_forms(text_terms(spark, sf), 1024, bucket=ft.portable_bucket, keys=(DOC,))
    kind = F.when(F.col("signed"), "signed").otherwise("unsigned")
    return r9(rows.withColumn("kind", kind)).select(DOC, "kind", "term", "value")


@query("h04_document_embeddings")
def h04(spark, sf):
    return packed_embeddings(ft.packed_tfidf(text_terms(spark, sf)), fx.docs(spark, sf), seed=1)


@query("h04_projection", TERMS + IDF + """, j as (select unnest(range(0, 96)) as pos)
select doc_idx, pos, round(sum(value*case when substr(md5('1:'||(pos//32)||':'||term), pos%32+1, 1) >= '8' then -1 else 1 end), 9) as value from tfidf, j group by doc_idx, pos""")
def h04_projection(spark, sf):
    """The signed projection that embeddings start from."""
    rows = project(ft.packed_tfidf(text_terms(spark, sf)).filter(F.size("terms") > 0), 96, seed=1)
    return r9(rows.select(DOC, F.posexplode("vector").alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint")))


NAMES = f""", names as (select distinct hier as target from fx_docs), nw as (select distinct target, upper(unnest({fx.tokens_sql('target')})) as term from names),
dt as (select doc_idx, upper(unnest({fx.tokens_sql('fulltext')})) as term from fx_docs),
hits as (select doc_idx, target, cast(count(*) as double) as value from dt join nw using (term) group by doc_idx, target)"""


def match_rows(spark, sf):
    d = fx.docs(spark, sf)
    analysed = d.select(DOC, F.lit("fulltext").alias("kind"), tx.separate_signs("fulltext").alias("terms"))
    names = ft.target_words(d.select(F.col("hier").alias("target")))
    return ft.target_matches(ft.count_vectors(analysed), names)


@query("h05_match_target_vectors", f"with {DOCS}{NAMES} select doc_idx, target, value from hits")
def h05(spark, sf):
    return match_rows(spark, sf)


@query("c10_target_name_words", f"with {DOCS}{NAMES} select term, count(*) as n_docs from (select distinct doc_idx, term from dt join nw using (term)) group by term")
def c10(spark, sf):
    d = fx.docs(spark, sf)
    analysed = d.select(DOC, F.lit("fulltext").alias("kind"), tx.separate_signs("fulltext").alias("terms"))
    upper = ft.count_vectors(analysed).select(DOC, F.upper("term").alias("term")).distinct()
    words = ft.target_words(d.select(F.col("hier").alias("target"))).select("term").distinct()
    return ft.restrict_to_vocabulary(upper, words).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


FOREIGN = f""", q as (select unnest({fx.words_sql('fulltext')}) as term from fx_docs where quality='1'), voc as (select term, row_number() over (order by term)-1 as index from (select distinct term from q))"""


def _foreign(spark, sf):
    d = fx.docs(spark, sf).filter("quality = '1'")
    return ft.vocabulary(ft.analyse_kinds(d, TEXT))


@query("h06_foreign_vocabulary", TERMS + FOREIGN + " select doc_idx, term, index, value from tf join voc using (term)")
def h06(spark, sf):
    rows = ft.restrict_to_vocabulary(text_counts(spark, sf), _foreign(spark, sf))
    return rows.select(DOC, "term", F.col("index").cast("bigint"), "value")


@query("c09_vocabulary_lookup", TERMS + FOREIGN + " select index, count(*) as n_docs from tf join voc using (term) group by index")
def c09(spark, sf):
    rows = ft.restrict_to_vocabulary(text_counts(spark, sf), _foreign(spark, sf))
    return rows.groupBy(F.col("index").cast("bigint").alias("index")).agg(F.count(F.lit(1)).alias("n_docs"))


@query("d21_vocabulary", TERMS + """, f as (select term, min((doc_idx, pos)) as first from t group by term)
select a.term, a.i as index, b.i as first_use from (select term, row_number() over (order by term)-1 as i from f) a join (select term, row_number() over (order by first)-1 as i from f) b using (term)""")
def d21(spark, sf):
    terms = text_terms(spark, sf)
    first = ft.vocabulary(terms, by_first_use=True).withColumnRenamed("index", "first_use")
    return ft.vocabulary(terms).join(first, "term").select(
        "term", F.col("index").cast("bigint"), F.col("first_use").cast("bigint")
    )


KINDS = {
    "status": ("status", "whole_item", 1), "target": ("target", "whole_item", 1),
    "brand_grams": ("brands", "item_ngrams", 1), "types": ("types", "whole_item", 1),
}
KIND_TERMS = f"""with {ITEMS}, t as (select doc_idx, 'status' as kind, unnest(status) as term from fx_items union all select doc_idx, 'target', unnest(target) from fx_items
union all select doc_idx, 'brand_grams', unnest(flatten(list_transform(brands, lambda x: {fx.words_sql('x')}))) from fx_items union all select doc_idx, 'types', unnest(types) from fx_items),
tf as (select doc_idx, kind, term, cast(count(*) as double) as value from t group by all)"""


@query("h07_several_kinds", KIND_TERMS + """, idf as (select kind, term, ln((1.0 + any_value(n))/(1.0 + count(*))) + 1 as idf from tf join (select kind, count(distinct doc_idx) as n from tf group by kind) using (kind) group by kind, term),
w as (select doc_idx, kind, term, value*idf as v from tf join idf using (kind, term))
select doc_idx, kind, term, round(v/sqrt(sum(v*v) over (partition by doc_idx, kind)), 9) as value from w""")
def h07(spark, sf):
    rows = ft.packed_tfidf(ft.analyse_kinds(fx.record_items(spark, sf), KINDS))
    return r9(unpacked(rows, (DOC, "kind"))).select(DOC, "kind", "term", "value")


@query("h09_vector_sizes", KIND_TERMS + " select kind, count(distinct term) as size from tf group by kind")
def h09(spark, sf):
    return ft.vector_sizes(ft.count_vectors(ft.analyse_kinds(fx.record_items(spark, sf), KINDS)))
