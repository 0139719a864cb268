"""Helpers shared by the operators: the held-out rule, scratch tables, and batch functions that add columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import scratch_path

PIECE_BYTES = 2 << 20
PIECE_ROWS = 1024


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cheap to reread, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of rows and bytes of ``column``; one long value is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))
        stop = min(max(stop, start + 1), start + PIECE_ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def append(
    df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable], column: str, keep: list[str] | None = None
) -> DataFrame:
    """``df`` (or its columns ``keep``) with new columns computed from slices of rows.

    ``make`` runs once per task and returns a function from a slice to one Arrow array per new field. An input column
    whose name is that of a new field is replaced. ``column`` may be read without being kept.
    """
    names = [f.name.lower() for f in fields]
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in names]
    read_too = [] if column in kept else [column]
    schema = T.StructType([*df.select(*kept).schema.fields, *fields])
    out = [f.name for f in schema.fields]

    def run(batches):
        function = make()
        for batch in batches:
            for piece in pieces(batch, column):
                new = function(piece)
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(kept))] + list(new), names=out)

    return df.select(*kept, *read_too).mapInArrow(run, schema)


def texts(piece: pa.RecordBatch, column: str) -> list:
    return piece.column(column).to_pylist()


def utf8(piece: pa.RecordBatch, column: str) -> list:
    """The values as UTF-8 bytes, null as no bytes."""
    return [b"" if v is None else v for v in pc.cast(piece.column(column), pa.binary()).to_pylist()]


def hash_share(column: str | Column, seed: int) -> Column:
    """A number in [0, 1) per value, the same in every run."""
    value = F.col(column) if isinstance(column, str) else column
    return F.shiftrightunsigned(F.xxhash64(value, F.lit(seed)), 11) / F.lit(float(1 << 53))
