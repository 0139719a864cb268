"""Joins with word lists: lemmas, parts of speech, large stop lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as tx
from shelfmark.operators.packed import chunked, flat, lists_of, look_up, places_in
from shelfmark.operators.skew import DOC


def first_analyses(lexicon: DataFrame, rank: str | None = None) -> DataFrame:
    """One analysis per form: the first by ``rank``, or by lemma and tag when the lexicon has no rank."""
    best = F.struct("lemma", "tag")
    chosen = F.min_by(best, F.col(rank)) if rank else F.min(best)
    return lexicon.groupBy("form").agg(chosen.alias("_best")).select("form", "_best.lemma", "_best.tag")


def _looked_up(df: DataFrame, tokens: str, table: DataFrame, build, schema: T.StructType) -> DataFrame:
    """``build(documents, owners, places, forms, rows)`` per chunk, a cell for every token and row of ``table`` for it.

    ``rows`` is the table's part for the chunk, taken per cell; a form without a row has one cell of nulls.
    """

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        owner, forms = flat(docs.column(tokens))
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        coded = known.column("form").combine_chunks().dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        many = np.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), 1)
        found = places_in(forms, coded.dictionary)
        cell = np.repeat(np.arange(len(owner)), many[found])
        nth = np.arange(len(cell)) - np.searchsorted(cell, cell)
        known_cell = found[cell] >= 0
        first = np.append((np.cumsum(many) - many)[:-1], 0)
        at = np.append(order, 0)[np.where(known_cell, first[found[cell]] + nth, len(order))]
        rows = known.take(pa.array(at, mask=~known_cell))
        return build(docs, owner[cell], place[cell], forms.take(pa.array(cell)), rows)

    others = [c for c in df.columns if c != tokens]
    return look_up(chunked(df, tokens, others), tokens, table, run, schema, term="form")


def _lemmas(forms: pa.Array, rows: pa.Table) -> pa.ChunkedArray:
    return pc.coalesce(rows.column("lemma"), forms)


def _tags(rows: pa.Table) -> pa.ChunkedArray:
    return pc.fill_null(rows.column("tag"), "X")


def _one(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def analyse(df: DataFrame, tokens: str, lexicon: DataFrame, doc: str = DOC) -> DataFrame:
    """``doc, pos, form, lemma, tag`` per token; an unknown form is its own lemma with tag X.

    The lexicon is asked once per chunk of documents and form.
    """
    schema = T.StructType([df.schema[doc], T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("form", "lemma", "tag")]])

    def build(docs, owner, place, forms, rows):
        own = docs.column(doc).take(pa.array(owner))
        return pa.table([own, pa.array(place, pa.int32()), forms, _lemmas(forms, rows), _tags(rows)], names=schema.names)

    return _looked_up(df.select(doc, tokens), tokens, lexicon.select("form", "lemma", "tag"), build, schema)


def _replaced(df: DataFrame, tokens: str, table: DataFrame, choose) -> DataFrame:
    """``df`` with the tokens that ``choose(forms, rows)`` gives with the mask of those to keep."""
    columns = [*[c for c in df.columns if c != tokens], tokens]

    def build(docs, owner, place, forms, rows):
        values, kept = choose(forms, rows)
        kept = np.flatnonzero(kept)
        lists = lists_of(owner[kept], _one(values).take(pa.array(kept)), docs.num_rows)
        return pa.table([lists if c == tokens else docs.column(c) for c in columns], names=columns)

    return _looked_up(df, tokens, table, build, df.select(*columns).schema)


def lemmatise(df: DataFrame, tokens: str, lexicon: DataFrame, doc: str = DOC) -> DataFrame:
    """Replace tokens by lemmas."""
    return _replaced(df, tokens, lexicon.select("form", "lemma"), lambda forms, rows: (_lemmas(forms, rows), np.ones(len(forms), bool)))


def keep_parts_of_speech(
    df: DataFrame, tokens: str, lexicon: DataFrame, only, lemmas: bool = True, doc: str = DOC
) -> DataFrame:
    """Keep tokens with the given parts of speech (letters or numeric codes), as lemmas or as forms."""
    letters = pa.array(tx.part_of_speech(only), pa.string())

    def choose(forms, rows):
        kept = pc.is_in(_one(_tags(rows)), value_set=letters).to_numpy(zero_copy_only=False)
        return (_lemmas(forms, rows) if lemmas else forms), kept

    return _replaced(df, tokens, lexicon.select("form", "lemma", "tag"), choose)


def remove_listed(df: DataFrame, tokens: str, stop_words: DataFrame, doc: str = DOC) -> DataFrame:
    """Drop tokens found in a stop-word table of any size (column ``form``)."""
    listed = stop_words.select("form").distinct().withColumn("listed", F.lit(True))
    return _replaced(df, tokens, listed, lambda forms, rows: (forms, _one(rows.column("listed").is_null()).to_numpy(zero_copy_only=False)))


def preprocess(
    df: DataFrame,
    text: str = "fulltext",
    *,
    lexicon: DataFrame | None = None,
    lemmas: bool = False,
    only=None,
    separate: bool = False,
    stop_words=(),
    min_length: int | None = None,
    max_length: int | None = None,
    to_ascii: bool = False,
    case: str | None = None,
    doc: str = DOC,
) -> DataFrame:
    """The whole clean-up chain. Without a lexicon it is one projection; with one it adds a single join."""
    if lexicon is None:
        if lemmas or only:
            raise ValueError("lemmas and parts of speech need a lexicon")
        return df.withColumn(
            text,
            tx.clean_text(
                text, separate=separate, stop_words=stop_words, min_length=min_length, max_length=max_length,
                to_ascii=to_ascii, case=case,
            ),
        )
    start = F.col(text)
    if not lemmas:
        start = F.array_join(tx.remove_words(tx.words(start), stop_words, min_length), " ")
    # only whether the text is empty is still asked behind the lookup: the text itself need not be stored and shuffled with its tokens
    out = df.withColumns({"_tokens": tx.separate_signs(start), "_empty": F.coalesce(F.col(text) == "", F.lit(False))}).drop(text)
    if only:
        out = keep_parts_of_speech(out, "_tokens", lexicon, only, lemmas, doc)
    elif lemmas:
        out = lemmatise(out, "_tokens", lexicon, doc)
    cleaned = tx.finish_text("_tokens", stop_words, min_length, max_length, to_ascii, case)
    return out.withColumn(text, F.when(F.col("_empty"), F.lit("")).otherwise(cleaned)).select(*df.columns)
