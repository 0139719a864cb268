"""Writers. Order, where it matters, is made by a range partitioning on the order columns, never in one task."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import items as it
from shelfmark.operators.skew import DOC


def metadata_rows(df: DataFrame, fields: list[str], delimiter: str = it.ITEM_DELIMITER, doc: str = DOC) -> DataFrame:
    return df.select(doc, *[it.join_items(f, delimiter).alias(f) for f in fields])


def write_metadata(df: DataFrame, path: str, fields: list[str], delimiter: str = it.ITEM_DELIMITER, doc: str = DOC):
    rows = metadata_rows(df, fields, delimiter, doc).orderBy(doc)
    rows.select(*fields).write.csv(path, header=True, escape='"', emptyValue="")


def write_texts(df: DataFrame, path: str, words: str = "words", doc: str = DOC):
    """One document per line, in document order; an empty text stays an empty line."""
    df.select(doc, F.coalesce(F.array_join(words, " "), F.lit("")).alias("value")).orderBy(doc).select(
        "value"
    ).write.text(path)


def write_documents(df: DataFrame, metadata: str, texts: str, table: str, fields: list[str], doc: str = DOC):
    """Aligned metadata and texts: one written table feeds both, so the two files cannot drift apart."""
    df.select(doc, "words", *fields).write.parquet(table)
    saved = df.sparkSession.read.parquet(table)
    write_metadata(saved, metadata, fields, doc=doc)
    write_texts(saved, texts, doc=doc)


def write_text_lines(df: DataFrame, path: str, text: str = "fulltext", doc: str = DOC):
    """Preprocessed texts in input order, empty lines kept."""
    df.orderBy(doc).select(F.col(text).alias("value")).write.text(path)


def write_predictions(df: DataFrame, path: str, doc: str = DOC, by_fold: bool = False):
    """Prediction rows with a header; with ``by_fold`` one folder per fold."""
    if by_fold:
        df.repartitionByRange("fold", doc).sortWithinPartitions("fold", doc).write.partitionBy("fold").csv(
            path, header=True, escape='"', emptyValue=""
        )
    else:
        df.orderBy(doc).drop(doc).write.csv(path, header=True, escape='"', emptyValue="")


def write_libraries(df: DataFrame, path: str, fields: list[str]):
    """One folder of tab-separated lines per library; records without any value are left out."""
    values = [F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in fields]
    rows = df.filter(F.trim(F.concat_ws("", *values)) != "")
    rows.select("library_id", F.concat_ws("\t", "id", *values).alias("value")).repartitionByRange(
        "library_id", "value"
    ).write.partitionBy("library_id").text(path)


def write_vertical(chunks: DataFrame, path: str):
    """Vertical text in document and page order. A chunk ends with a line end, which the writer puts back."""
    text = F.regexp_replace("chunk", "\n\\z", "")
    chunks.orderBy("doc_id", "page_no").select(text.alias("value")).write.text(path)


def write_merged(df: DataFrame, path: str):
    """Merged records with a header, in id order."""
    df.orderBy("id").write.csv(path, header=True, escape='"', emptyValue="")


def write_text_folder(df: DataFrame, folder: str, name: str, text: str) -> int:
    """One file per row that has a text, ``<partition>/<row>~<name>.txt``; a text ends with a line end. Returns their number.

    Tasks write through the file system of the folder's URI. A repeated task writes the same files again, and a file is
    complete when it gets its name.
    """

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/{part}", recursive=True)
        for batch in batches:
            written = 0
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if "/" in n or "~" in n:
                    raise ValueError(f"{n!r} is no file name")
                row += 1
                if t:
                    with system.open_output_stream(f"{root}/{part}/.{row}") as out:
                        out.write(f"{t}\n".encode())
                    system.move(f"{root}/{part}/.{row}", f"{root}/{part}/{row}~{n}.txt")
                    written += 1
            yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    return df.select(name, text).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
