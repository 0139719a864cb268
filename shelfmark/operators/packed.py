"""Term lists as packed rows, and lookups of their terms in large tables, chunk by chunk.

A chunk is a run of whole documents of one task with about ``CHUNK_CELLS`` terms. A large table (idf, lexicon) is asked once
per chunk and distinct term, not once per document and term; its answers meet the documents of the chunk in one task,
where the documents are still packed. So documents are shuffled as rows of arrays, once, and a frequent term costs one row
per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.skew import lookup_join
from shelfmark.session import stored

CHUNK_CELLS = 1 << 19


def flat(lists) -> tuple[np.ndarray, pa.Array]:
    """Owning row and value of every element of a list column; null lists are empty, null elements are left out."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    values = lists.flatten()
    if values.null_count:
        owner, values = owner[values.is_valid().to_numpy(zero_copy_only=False)], values.drop_null()
    return owner, values


def lists_of(owner: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    """List column of ``rows`` rows from elements in the order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), values)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``CHUNK_CELLS`` elements; a row stays whole."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(sizes) // CHUNK_CELLS
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else []
    for low, high in zip(starts, [*starts[1:], len(runs)], strict=True):
        yield batch.slice(low, high - low)


def _counts(lists) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and count of the distinct terms of every row."""
    owner, terms = flat(lists)
    coded = terms.dictionary_encode()
    many = max(len(coded.dictionary), 1)
    cells, counts = np.unique(owner * many + coded.indices.to_numpy(), return_counts=True)
    owner, code = np.divmod(cells, many)
    return owner, coded.dictionary.take(pa.array(code)), counts.astype(np.float64)


def _fields(df: DataFrame, keys) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def count_rows(analysed: DataFrame, keys, terms: str = "terms") -> DataFrame:
    """``keys, term, value``: occurrences per row and term, counted inside the row."""
    keys = list(keys)
    element = analysed.schema[terms].dataType.elementType
    schema = T.StructType([*_fields(analysed, keys), T.StructField("term", element), T.StructField("value", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, terms):
                owner, term, counts = _counts(part.column(terms))
                own = [part.column(k).take(pa.array(owner)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, term, pa.array(counts)], names=[*keys, "term", "value"])

    return analysed.select(*keys, terms).mapInArrow(run, schema)


def hash_rows(analysed: DataFrame, keys, buckets: int, codes: Callable[[pa.Array], np.ndarray], forms=(False,), terms: str = "terms") -> DataFrame:
    """``keys, signed, term, value``: hash vectors of length one of every row, summed inside the row.

    ``codes`` gives twice the bucket, and one more where the term counts negatively, for distinct terms. ``forms`` says whether
    signed vectors are made, plain ones, or both in one pass.
    """
    keys = list(keys)
    added = [("signed", T.BooleanType()), ("term", T.LongType()), ("value", T.DoubleType())]
    schema = T.StructType([*_fields(analysed, keys), *[T.StructField(*x) for x in added]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, terms):
                owner, words = flat(part.column(terms))
                coded = words.dictionary_encode()
                code = codes(coded.dictionary)[coded.indices.to_numpy()]
                cells, place = _distinct(owner * buckets + (code >> 1), part.num_rows * buckets)
                row, bucket = np.divmod(cells, buckets)
                for signed in forms:
                    sums = np.bincount(place, 1 - 2.0 * (code & 1) if signed else None, len(cells)).astype(np.float64)
                    norm = np.sqrt(np.bincount(row, sums * sums, part.num_rows))
                    kept = np.flatnonzero(sums)
                    own = [part.column(k).take(pa.array(row[kept])) for k in keys]
                    values = [np.full(len(kept), signed), bucket[kept], sums[kept] / norm[row[kept]]]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, values)], names=schema.names)

    return analysed.select(*keys, terms).mapInArrow(run, schema)


def _distinct(numbers: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers below ``many`` in their order, and the place of every number among them."""
    if many > 8 * CHUNK_CELLS:
        return np.unique(numbers, return_inverse=True)
    seen = np.zeros(many, bool)
    seen[numbers] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[numbers]


def chunked(df: DataFrame, column: str, keys, count: bool = False) -> DataFrame:
    """``keys, column, chunk``, stored; with ``count`` the distinct terms of ``column`` and their ``values``."""
    keys = list(keys)
    schema = T.StructType([*_fields(df, keys), df.schema[column], T.StructField("chunk", T.LongType())])
    if count:
        schema = schema.add("values", T.ArrayType(T.DoubleType()))

    def run(batches):
        chunk, cells = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, column):
                lists, extra = part.column(column), []
                if count:
                    owner, terms, counts = _counts(lists)
                    lists = lists_of(owner, terms, part.num_rows)
                    extra = [lists_of(owner, pa.array(counts), part.num_rows)]
                if cells >= CHUNK_CELLS:
                    chunk, cells = chunk + 1, 0
                cells += len(lists.flatten())
                number = pa.array(np.full(part.num_rows, chunk))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], lists, number, *extra], names=schema.names)

    return stored(df.select(*keys, column).mapInArrow(run, schema), "packed")


def look_up(
    chunks: DataFrame, column: str, table: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema, by=(), term: str = "term", tasks: int | None = None
) -> DataFrame:
    """``run`` over the rows of every chunk (and ``by``) and the rows of ``table`` for its terms.

    With ``tasks``, the number of chunks, a task sorts about one of them, however many partitions the session has.
    ``table`` has one row per ``by, term``; terms without a row are not among the answers.
    """
    places = chunks.select("chunk", *by, F.explode(column).alias(term)).distinct()
    keys = ["chunk", *by]
    asked = lookup_join(places, table, [*by, term]).withColumnsRenamed({k: f"asked_{k}" for k in keys})
    if tasks:
        chunks, asked = chunks.repartition(tasks, *keys), asked.repartition(tasks, *[f"asked_{k}" for k in keys])
    return chunks.groupBy(*keys).cogroup(asked.groupBy(*[f"asked_{k}" for k in keys])).applyInArrow(run, schema)


def places_in(terms: pa.Array, known) -> np.ndarray:
    """Place of every term among ``known``, -1 where it is not."""
    known = known.combine_chunks() if isinstance(known, pa.ChunkedArray) else known
    return pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)


def weigh(chunks: DataFrame, idf: DataFrame, by=("kind",)) -> DataFrame:
    """Packed counts times idf, every row of length one; terms outside the idf table are dropped. ``chunks`` are stored."""
    names, schema = chunks.columns, chunks.schema
    tasks = max(chunks.select("chunk").distinct().count(), 1)

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        n = docs.num_rows
        owner, terms = flat(docs.column("terms"))
        values = flat(docs.column("values"))[1].to_numpy()
        place = places_in(terms, known.column("term"))
        kept = np.flatnonzero(place >= 0)
        owner, place = owner[kept], place[kept]
        weights = values[kept] * known.column("idf").to_numpy()[place] if len(kept) else np.zeros(0)
        norm = np.sqrt(np.bincount(owner, weights * weights, n))[owner]
        weights = np.divide(weights, norm, out=np.zeros_like(weights), where=norm > 0)
        new = {"terms": lists_of(owner, terms.take(pa.array(kept)), n), "values": lists_of(owner, pa.array(weights), n)}
        return pa.table([new.get(c, docs.column(c)) for c in names], names=names)

    return look_up(chunks, "terms", idf.select(*by, "term", "idf"), run, schema, by, tasks=tasks)


def unpacked(packed: DataFrame, keys) -> DataFrame:
    """``keys, term, value`` of packed rows."""
    return packed.select(*keys, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("values").alias("value"))))
