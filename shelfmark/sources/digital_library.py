"""Digitised documents: Dublin Core and page references from a document's XML, words from its page XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.skew import exploded

# The Dublin Core fields in output order.
DUBLIN_CORE = ("title", "creator", "subject", "publisher", "date", "identifier", "language", "rights")
# Fixed value: the word that marks a word split at the line end.
SPLIT_MARK = "172"


def _all(c: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(c if isinstance(c, Column) else F.col(c), F.lit(pattern), F.lit(1))


def dublin_core(xml: str = "xml") -> list[Column]:
    return [_all(xml, f"<dc:{name}>(.*?)</dc:{name}>").alias(name) for name in DUBLIN_CORE]


def page_references(documents: DataFrame) -> DataFrame:
    """``doc_id, page_no, page_id`` in the order of the references."""
    refs = _all("xml", 'rdf:resource="info:fedora/(uuid[^"]*)')
    return exploded(documents, ["doc_id"], refs, "page_no", "page_id", kind="posexplode")


def page_lines(xml: str | Column = "xml") -> Column:
    """Words of every text line of a page."""
    return F.transform(_all(xml, "TextLine(.*?)TextLine>"), lambda line: _all(line, 'CONTENT="([^"]*)'))


def _tagged(name: str, value: Column) -> Column:
    return F.concat(F.lit(f" <{name}>"), value, F.lit(f"</{name}>"))


def _header() -> Column:

    def tagged(name: str, values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: _tagged(name, v)), "")

    fields = [tagged(name, values) for name, values in zip(DUBLIN_CORE, dublin_core())]
    return F.concat(F.lit("<doc>\n<meta_doc>"), *fields, F.lit(" </meta_doc>\n"))


def _append_line(text: Column, words: Column) -> Column:
    """Words one per line; a closing split mark is dropped with the preceding line end, which glues the two halves."""
    split = F.get(words, F.size(words) - 1) == SPLIT_MARK
    kept = F.when(split, F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    longer = F.concat(text, F.array_join(F.transform(kept, lambda w: F.concat(w, F.lit("\n"))), ""))
    shorter = F.substring(longer, F.lit(1), F.length(longer) - 1)
    return F.when(F.size(words) == 0, text).when(split, shorter).otherwise(longer)


def vertical_text(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, chunk``: a head, one chunk per page and an end; in this order they are the document's text.

    A page is one row from XML to chunk, so a document of any length is spread over its pages. A page that is not
    found gives an error mark.
    """
    found = page_references(documents).join(pages.select("page_id", page_lines().alias("_lines")), "page_id", "left")
    number = F.col("page_no").cast("string")
    start = F.concat(
        F.lit("<page>\n<meta_page>"), _tagged("num", number), _tagged("source", F.col("page_id")), F.lit(" </meta_page>\n")
    )
    body = F.when(F.col("_lines").isNull(), F.concat(start, F.lit("<error>\n"))).otherwise(
        F.aggregate("_lines", start, _append_line)
    )
    rows = found.select("doc_id", "page_no", F.concat(body, F.lit("</page>\n")).alias("chunk"))
    ends = F.array(
        F.struct(F.lit(-1).alias("page_no"), _header().alias("chunk")),
        F.struct(F.size(_all("xml", 'rdf:resource="info:fedora/(uuid[^"]*)')).alias("page_no"), F.lit("</doc>\n").alias("chunk")),
    )
    return rows.unionByName(documents.select("doc_id", F.inline(ends)))


def page_errors(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """References without a page."""
    return page_references(documents).join(pages.select("page_id"), "page_id", "left_anti")
