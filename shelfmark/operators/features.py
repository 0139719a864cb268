"""Feature tables in long form: ``fold, doc, kind, term, value``. A document without a row is empty for that kind.

``keys`` are the columns that identify one vector, by default document and kind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import items as it
from shelfmark.functions import text as tx
from shelfmark.operators import packed
from shelfmark.operators.skew import DOC, dense_index, exploded, lookup_join
from shelfmark.session import stored

# Fixed value: default number of hash buckets.
HASH_BUCKETS = 65_536

# Terms whose codes a task keeps from one batch to the next.
KNOWN_TERMS = 1 << 19

# Analysers by name; n is the gram size.
ANALYSERS = {
    "whole_item": lambda c, n: c,
    "item_ngrams": tx.item_ngrams,
    "text_ngrams": tx.text_ngrams,
}


def _analyser(name: str, n: int):
    return lambda items: F.when(F.size(items) > 0, ANALYSERS[name](items, n))


def analyse_kinds(df: DataFrame, kinds: dict[str, tuple], keep=(DOC,)) -> DataFrame:
    """``keep, kind, terms`` for documents that are not empty in the kind, all kinds in one pass.

    ``kinds`` maps a name to ``(column, analyser name, n)``; full text is a string column, other fields are item lists.
    """
    parts = []
    for name, (column, analyser, n) in kinds.items():
        items = tx.words(column) if dict(df.dtypes)[column] == "string" else F.col(column)
        terms = tx.bind(items, _analyser(analyser, n))
        parts.append(F.struct(F.lit(name).alias("kind"), terms.alias("terms")))
    rows = exploded(df, list(keep), F.array(*parts), "kind", "terms", kind="inline")
    return rows.filter(F.col("terms").isNotNull())


def usable(df: DataFrame, kind: tuple, doc: str = DOC) -> DataFrame:
    """``doc`` of the documents that :func:`analyse_kinds` gives a row for this ``(column, analyser name, n)``; no text is cut."""
    column = kind[0]
    text = dict(df.dtypes)[column] == "string"
    return df.filter(F.col(column).rlike(f"[^{it.SPACE_CLASS}]") if text else F.size(column) > 0).select(doc)


def documents_per_kind(analysed: DataFrame, by=("kind",)) -> DataFrame:
    return analysed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))


def count_vectors(analysed: DataFrame, keys=(DOC, "kind")) -> DataFrame:
    """Occurrences per document and term, counted inside each row: no shuffle."""
    return packed.count_rows(analysed, keys)


def packed_tfidf(analysed: DataFrame, by=("kind",), doc: str = DOC) -> DataFrame:
    """``doc, by, terms, values, chunk``: the vectors of :func:`tfidf` as one row per document, counted once.

    The idf table is asked once per chunk and term, and the lengths need no shuffle.
    """
    counts = packed.chunked(analysed, "terms", (doc, *by), count=True)
    df = counts.select(*by, F.explode("terms").alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    return packed.weigh(counts, frequencies_to_idf(df, documents_per_kind(counts, by), by), by)


def inverse_frequencies(counts: DataFrame, n_docs: DataFrame, by=("kind",)) -> DataFrame:
    """``by, term, df, idf`` with ln((1 + n) / (1 + df)) + 1. ``n_docs`` holds one row per kind (and fold)."""
    df = counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    # one row per kind and fold
    return frequencies_to_idf(df, n_docs, by)


def frequencies_to_idf(df: DataFrame, n_docs: DataFrame, by=("kind",)) -> DataFrame:
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    return df.join(F.broadcast(n_docs), list(by)).select(*by, "term", "df", idf.alias("idf"))


def normalise(vectors: DataFrame, keys=(DOC, "kind")) -> DataFrame:
    """Vectors of length one. A window over one document's terms."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*keys)))
    return vectors.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(F.lit(0.0)))


def tfidf(counts: DataFrame, idf: DataFrame, by=("kind",), keys=(DOC, "kind")) -> DataFrame:
    """Weighted, normalised vectors; terms outside the idf table are dropped."""
    weighed = lookup_join(counts, idf.select(*by, "term", "idf"), [*by, "term"])
    return normalise(weighed.withColumn("value", F.col("value") * F.col("idf")).drop("idf"), keys)


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


def portable_bucket(term: Column, buckets: int) -> Column:
    """Bucket that any engine with md5 can reproduce."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % buckets


def hash_entries(terms: str | Column, buckets: int, bucket=term_bucket) -> Column:
    """Normalised hash vector of a term list as ``ARRAY<STRUCT<term, value>>``, made inside the row."""
    counted = tx.count_terms(F.transform(it.col(terms), lambda t: bucket(t, buckets)))

    def scale(entries: Column) -> Column:
        square = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"] * e["value"])
        return tx.bind(F.sqrt(square), lambda norm: F.transform(
            entries, lambda e: F.struct(e["term"].alias("term"), (e["value"] / norm).alias("value"))
        ))

    return tx.bind(counted, scale)


def count_entries(terms: str | Column) -> Column:
    """Counts of a term list as ``ARRAY<STRUCT<term, value>>`` with a 64-bit hash for each term, made inside the row."""
    return F.transform(tx.count_terms(F.transform(it.col(terms), lambda t: F.xxhash64(t))), lambda e: F.struct(
        e["term"].alias("term"), e["value"].cast("double").alias("value")
    ))


def hash_vectors(
    analysed: DataFrame, buckets: int = HASH_BUCKETS, non_negative: bool = True, bucket=term_bucket, keys=(DOC, "kind")
) -> DataFrame:
    """Normalised hash vectors, made inside the row; with ``non_negative`` off, half of the terms count negatively."""
    return hash_forms(analysed, buckets, (not non_negative,), bucket, keys).drop("signed")


def hash_forms(analysed: DataFrame, buckets: int = HASH_BUCKETS, forms=(False, True), bucket=term_bucket, keys=(DOC, "kind")) -> DataFrame:
    """``keys, signed, term, value``: :func:`hash_vectors` of one or both forms in one pass and without a shuffle.

    Buckets by md5 are made once per task and term while it keeps the term; others are columns, made per word.
    """
    if bucket is portable_bucket:
        return packed.hash_rows(analysed, keys, buckets, portable_codes(buckets), forms)
    code = lambda t: 2 * bucket(t, buckets) + bucket(F.concat(F.lit("sign:"), t), 2)
    coded = analysed.withColumn("terms", F.transform("terms", code))
    return packed.hash_rows(coded, keys, buckets, lambda numbers: numbers.to_numpy(), forms)


def portable_codes(buckets: int):
    """Function that gives twice the :func:`portable_bucket` of every term, and one more where its sign is negative."""
    md5, number, known = hashlib.md5, int.from_bytes, {}

    def code(term: str) -> int:
        plain = term.encode()
        return number(md5(plain).digest()[:4]) % buckets * 2 + (md5(b"sign:" + plain).digest()[3] & 1)

    def codes(terms: pa.Array) -> np.ndarray:
        if len(known) > KNOWN_TERMS:
            known.clear()
        words = terms.to_pylist()
        known.update((t, code(t)) for t in words if t not in known)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    return codes


def dense_hash_vectors(analysed: DataFrame, buckets: int, bucket=term_bucket, doc: str = DOC) -> DataFrame:
    """``doc, vector``: hash vectors as arrays, for neighbours and clusters."""

    def dense(cells: Column) -> Column:
        position = lambda i: F.coalesce(cells[i.cast("bigint")], F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), position)

    vector = tx.bind(F.map_from_entries(hash_entries("terms", buckets, bucket)), dense)
    return analysed.select(doc, vector.alias("vector"))


def target_words(targets: DataFrame, target: str = "target") -> DataFrame:
    """``target, term``: the distinct upper-case words of each target's name."""
    words = F.array_distinct(F.transform(tx.separate_signs("target"), F.upper))
    names = targets.select(F.col(target).alias("target")).distinct()
    return names.select("target", F.explode(words).alias("term"))


def target_matches(counts: DataFrame, names: DataFrame, doc: str = DOC) -> DataFrame:
    """``doc, target, value``: words of the document that occur in the target's name.

    The names are stored, so that the planner knows their size; while they are few, the documents' words are not shuffled.
    """
    names = stored(names, "names")
    hits = lookup_join(counts.select(doc, F.upper("term").alias("term"), "value"), names, ["term"])
    return hits.groupBy(doc, "target").agg(F.sum("value").alias("value"))


def vocabulary(analysed: DataFrame, by_first_use: bool = False, doc: str = DOC) -> DataFrame:
    """``term, index``: alphabetical, or in the order of first use."""
    if not by_first_use:
        terms = analysed.select(F.explode("terms").alias("term")).distinct()
        return dense_index(terms, ["term"], "index")
    rows = analysed.select(doc, F.posexplode("terms").alias("pos", "term"))
    first = rows.groupBy("term").agg(F.min(F.struct(doc, "pos")).alias("first"))
    return dense_index(first, ["first"], "index").select("term", "index")


def restrict_to_vocabulary(counts: DataFrame, vocab: DataFrame, spread_by: str = DOC) -> DataFrame:
    """Terms with their index; the others are dropped."""
    return lookup_join(counts, vocab, ["term"])


def vector_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind").agg(F.count_distinct("term").alias("size"))
