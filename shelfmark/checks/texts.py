"""Queries over text clean-up, lexicon joins and long texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from shelfmark.checks import fixtures as fx
from shelfmark.checks.registry import query
from shelfmark.functions import text as tx
from shelfmark.operators import lexicon as lx
from shelfmark.operators.skew import DOC, exploded
from shelfmark.plans import commands
from shelfmark.session import scratch_path
from shelfmark.sources import files, sinks

DOCS, LEXICON = fx.DOCS_SQL, fx.LEXICON_SQL
STOP = ("the", "of", "and", "and,", "la", "der")
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
W, T = fx.words_sql("fulltext"), fx.tokens_sql("fulltext")


def joined(df, column, name="fulltext"):
    return df.select(DOC, F.array_join(column, " ").alias(name))


def simple(expr):
    return f"with {DOCS} select doc_idx, array_to_string({expr}, ' ') as fulltext from fx_docs"


@query("g01_separate_signs", simple(T))
def g01(spark, sf):
    return joined(fx.docs(spark, sf), tx.separate_signs("fulltext"))


@query("g05_stop_words", simple(f"list_filter({W}, lambda x: x not in ({STOP_SQL}))"))
def g05(spark, sf):
    return joined(fx.docs(spark, sf), tx.remove_words(tx.words("fulltext"), STOP))


EARLY = f"array_to_string(list_filter({W}, lambda x: x not in ({STOP_SQL}) and length(x)>=3), ' ')"


@query("g06_early_removal", simple(fx.tokens_sql(EARLY)))
def g06(spark, sf):
    early = F.array_join(tx.remove_words(tx.words("fulltext"), STOP, 3), " ")
    return joined(fx.docs(spark, sf), tx.separate_signs(early))


@query("g07_word_length", simple(f"list_filter({W}, lambda x: length(x)>=4 and length(x)<=8)"))
def g07(spark, sf):
    return joined(fx.docs(spark, sf), tx.remove_words(tx.words("fulltext"), (), 4, 8))


def ascii_sql(e: str) -> str:
    """The same mapping, character classes taken anew from the Unicode data."""
    accented = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
                if c not in tx.ASCII_FORMS and unicodedata.normalize("NFD", c)[0].isascii()]
    bases = [unicodedata.normalize("NFD", c)[0] for c in accented]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    e = f"translate({e}, {quote(''.join(accented))}, {quote(''.join(bases))})"
    for sign, form in tx.ASCII_FORMS.items():
        e = f"replace({e}, {quote(sign)}, {quote(form)})"
    return e


@query("g08_transliterate", f"with {DOCS} select doc_idx, {ascii_sql('fulltext')} as fulltext from fx_docs")
def g08(spark, sf):
    return fx.docs(spark, sf).select(DOC, tx.transliterate("fulltext").alias("fulltext"))


@query("g09_change_case", f"with {DOCS} select doc_idx, upper(hier) as upper_text, lower(hier) as lower_text from fx_docs")
def g09(spark, sf):
    return fx.docs(spark, sf).select(
        DOC, tx.change_case("hier", "upper").alias("upper_text"), tx.change_case("hier", "lower").alias("lower_text")
    )


CHAIN = (
    f"with {DOCS}, e as (select doc_idx, fulltext, {EARLY} as early from fx_docs) select doc_idx, case when fulltext='' then '' else lower("
    + ascii_sql(f"array_to_string(list_filter({fx.tokens_sql('early')}, lambda x: x not in ({STOP_SQL}) and length(x)>=3 and length(x)<=9), ' ')")
    + ") end as fulltext from e"
)


@query("g10_clean_text", CHAIN)
def g10(spark, sf):
    df = lx.preprocess(
        fx.docs(spark, sf), separate=True, stop_words=STOP, min_length=3, max_length=9, to_ascii=True, case="lower"
    )
    return df.select(DOC, "fulltext")


@query("g11_normalise_spaces", simple(W))
def g11(spark, sf):
    return fx.docs(spark, sf).select(DOC, tx.normalise_spaces("fulltext").alias("fulltext"))


@query("g12_text_ngrams", f"""with {DOCS}, w as (select doc_idx, {W} as w from fx_docs),
g as (select doc_idx, case when len(w)<3 then [array_to_string(w,'_')] else list_transform(range(1, len(w)-1), lambda i: array_to_string(w[i:i+2],'_')) end as g from w)
select doc_idx, len(g) as n_grams, array_to_string(g,' ') as grams from g""")
def g12(spark, sf):
    d = fx.docs(spark, sf).select(DOC, tx.text_ngrams(tx.words("fulltext"), 3).alias("grams"))
    return d.select(DOC, F.size("grams").cast("bigint").alias("n_grams"), F.array_join("grams", " ").alias("grams"))


@query("g13_item_ngrams", f"""with {DOCS}, i as (select doc_idx, unnest(string_split(fulltext, '.')) as item, generate_subscripts(string_split(fulltext,'.'),1) as pos from fx_docs),
w as (select doc_idx, pos, {fx.words_sql('item')} as w from i),
g as (select doc_idx, pos, case when len(w)<2 then [array_to_string(w,' ')] else list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1],' ')) end as g from w)
select doc_idx, string_agg(array_to_string(g,'|'), '|' order by pos) as grams from g group by doc_idx""")
def g13(spark, sf):
    grams = tx.item_ngrams(F.split("fulltext", r"\.", -1), 2)
    return fx.docs(spark, sf).select(DOC, F.array_join(grams, "|").alias("grams"))


@query("g14_whole_items", f"with {fx.RECORD_ITEMS_SQL} select doc_idx, unnest(types) as term from fx_items")
def g14(spark, sf):
    return fx.record_items(spark, sf).select(DOC, F.explode("types").alias("term"))


@query("e13_word_parts", f"""with {DOCS}, w as (select doc_idx, {W} as w from fx_docs), p as (select doc_idx, w, unnest(range(0, greatest(cast(ceil(len(w)/50.0) as bigint),1))) as part_no from w)
select doc_idx, part_no, array_to_string(w[part_no*50+1:part_no*50+50],' ') as part, cast(part_no = greatest(cast(ceil(len(w)/50.0) as bigint),1)-1 as int) as is_last from p""")
def e13(spark, sf):
    parts = tx.word_parts(tx.words("fulltext"), 50)
    rows = exploded(fx.docs(spark, sf), [DOC], parts, "part_no", "words", "is_last", kind="inline")
    return rows.select(
        DOC, F.col("part_no").cast("bigint"), F.array_join("words", " ").alias("part"), F.col("is_last").cast("int")
    )


TOKENS = f"""with {DOCS}, {LEXICON}, t as (select doc_idx, unnest(t) as form, generate_subscripts(t,1) as pos from (select doc_idx, {T} as t from fx_docs)),
a as (select doc_idx, pos, t.form, coalesce(lemma, t.form) as lemma, coalesce(tag,'X') as tag from t left join fx_lexicon l on t.form=l.form)"""


@query("c07_remove_listed", f"""with {DOCS}, stop as (select distinct lang as form from documents union select unnest(['the','of','and','la','en'])),
t as (select doc_idx, unnest(t) as form, generate_subscripts(t,1) as pos from (select doc_idx, {T} as t from fx_docs))
select d.doc_idx, coalesce(s, '') as fulltext from fx_docs d left join (select doc_idx, string_agg(form, ' ' order by pos) as s from t where form not in (select form from stop) group by doc_idx) using (doc_idx)""")
def c07(spark, sf):
    d = fx.docs(spark, sf)
    listed = d.select(F.col("target").alias("form")).unionByName(
        d.select(F.explode(F.array(*map(F.lit, ("the", "of", "and", "la", "en")))).alias("form"))
    )
    out = lx.remove_listed(d.select(DOC, tx.separate_signs("fulltext").alias("tokens")), "tokens", listed)
    return joined(out, "tokens")


@query("c08_lexicon_lookup", TOKENS + " select doc_idx, pos-1 as pos, form, lemma, tag from a")
def c08(spark, sf):
    d = fx.docs(spark, sf).select(DOC, tx.separate_signs("fulltext").alias("tokens"))
    rows = lx.analyse(d, "tokens", lx.first_analyses(fx.lexicon(spark, sf)))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


WHOLE = " select d.doc_idx, coalesce(s,'') as fulltext from fx_docs d left join (select doc_idx, string_agg({c}, ' ' order by pos) as s from a {w} group by doc_idx) using (doc_idx)"


@query("g02_lemmatise", TOKENS + WHOLE.format(c="lemma", w=""))
def g02(spark, sf):
    d = fx.docs(spark, sf).select(DOC, tx.separate_signs("fulltext").alias("tokens"))
    return joined(lx.lemmatise(d, "tokens", fx.lexicon(spark, sf)), "tokens")


@query("g03_keep_parts_of_speech", TOKENS + WHOLE.format(c="form", w="where tag in ('N','V','C')"))
def g03(spark, sf):
    d = fx.docs(spark, sf).select(DOC, tx.separate_signs("fulltext").alias("tokens"))
    return joined(lx.keep_parts_of_speech(d, "tokens", fx.lexicon(spark, sf), ["N", 5, "4"], lemmas=False), "tokens")


@query("g04_numeric_parts_of_speech", TOKENS + " select tag, count(*) as n from a where tag in ('A','P','D','I','Z') group by tag")
def g04(spark, sf):
    d = fx.docs(spark, sf).select(DOC, tx.separate_signs("fulltext").alias("tokens"))
    rows = lx.analyse(d, "tokens", fx.lexicon(spark, sf))
    kept = rows.filter(F.col("tag").isin(tx.part_of_speech([2, 3, 6, 10, "Z"])))
    return kept.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("g21_join_hyphenated", f"with {fx.PAGES_SQL} select record_id, page_no, regexp_replace(regexp_replace(text, '-\\r?\\n', '', 'g'), '\\r?\\n', ' ', 'g') as text from fx_pages")
def g21(spark, sf):
    return fx.pages(spark, sf).select("record_id", "page_no", tx.join_hyphenated("text").alias("text"))


LEMMA_CHAIN = (
    TOKENS + ", c as (select doc_idx, string_agg(lemma, ' ' order by pos) as s from a where lemma not in (" + STOP_SQL
    + ") and length(lemma)>=2 group by doc_idx) select row_number() over (order by d.doc_idx)-1 as doc_idx, lower(coalesce(s,'')) as fulltext from fx_docs d left join c using (doc_idx)"
)


@query("j01_preprocessing", LEMMA_CHAIN)
def j01(spark, sf):
    """Text file in, cleaned text file out, in input order."""
    source, out = scratch_path(spark, "data.txt"), scratch_path(spark, "clean.txt")
    d = fx.docs(spark, sf)
    sinks.write_texts(files.tokens(d), source)
    commands.preprocessing(spark, source, out, lexicon=fx.lexicon(spark, sf), lemmas=True, stop_words=STOP, min_length=2, case="lower")
    return files.number_lines(files.scan_texts(spark, out))


@query("a22_text_line_sink", f"with {DOCS} select row_number() over (order by doc_idx)-1 as doc_idx, lower(case when doc_idx%9=0 then '' else array_to_string({W},' ') end) as fulltext from fx_docs")
def a22(spark, sf):
    out = scratch_path(spark, "lines.txt")
    d = fx.docs(spark, sf).withColumn("fulltext", F.when(F.col(DOC) % 9 == 0, F.lit("")).otherwise(F.col("fulltext")))
    sinks.write_text_lines(lx.preprocess(d, case="lower"), out)
    return files.number_lines(files.scan_texts(spark, out))
