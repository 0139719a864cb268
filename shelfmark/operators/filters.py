"""Document filters of the selection step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import items as it
from shelfmark.operators.counts import explode_fields, items_per_field
from shelfmark.operators.skew import BLOCK_ROWS, DOC, blocked_rank, lookup_join, sample_key
from shelfmark.session import cut


def non_empty(df: DataFrame, *fields: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [~it.is_empty(f) for f in fields]))


def empty(df: DataFrame, *fields: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [it.is_empty(f) for f in fields]))


def keep_matching_items(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return df.withColumns({f: it.match_items(f, p) for f, p in patterns.items()})


def _regroup(df: DataFrame, kept, fields: list[str], doc: str) -> DataFrame:
    """Put kept ``(doc, field, pos, item)`` rows back as arrays; a document with an emptied field is dropped."""
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "item")))).alias(f"_{f}") for f in fields
    ]
    out = df.join(kept.groupBy(doc).agg(*lists), doc, "left")
    emptied = [~it.is_empty(f) & it.is_empty(f"_{f}") for f in fields]
    out = out.filter(~reduce(lambda a, b: a | b, emptied))
    new = {f: F.when(~it.is_empty(f"_{f}"), F.col(f"_{f}.item")) for f in fields}
    return out.withColumns(new).select(*df.columns)


def _back(df: DataFrame, work: DataFrame, fields: list[str], doc: str) -> DataFrame:
    """The filtered fields joined to the other columns of their documents."""
    if set(df.columns) == {doc, *fields}:
        return work.select(*df.columns)
    return df.drop(*fields).join(work, doc).select(*df.columns)


def max_per_item(df: DataFrame, quotas: dict[str, float], doc: str = DOC, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep at most n occurrences of each item, earlier documents first.

    An int (or a float above 1) is a count; a float up to 1 is a share of the item's occurrences before this step.
    Fields go in column order: a document dropped at a later field has already used quota of the earlier ones. Each
    pass reads its input three times, so ids and constrained fields alone are cut before every pass.
    """
    fields = [c for c in df.columns if c in quotas]
    work = cut(df.select(doc, *fields))
    before = items_per_field(work, fields, doc)
    for n, f in enumerate(fields):
        work = cut(work) if n else work
        quota = quotas[f]
        rows = explode_fields(work, [f], doc)
        per_key = None
        limit = F.lit(quota)
        if isinstance(quota, float) and quota <= 1:
            share = F.floor(F.col("n") * F.lit(quota) + F.lit(0.5))
            per_key = before.filter(F.col("field") == f).select("item", share.alias("_quota"))
            limit = F.col("_quota")
        elif isinstance(quota, float):
            limit = F.ceil(F.lit(quota))
        ranked = blocked_rank(rows, ["item"], [doc, "pos"], block_rows, per_key=per_key)
        work = _regroup(work, ranked.filter(F.col("rank") <= limit), [f], doc)
    return _back(df, work, fields, doc)


def min_per_item(df: DataFrame, least: dict[str, int], doc: str = DOC) -> DataFrame:
    """Drop items with fewer occurrences than given; counted once, not repeated to a fixpoint. One pass, all fields."""
    fields = [c for c in df.columns if c in least]
    bound = reduce(lambda e, f: e.when(F.col("field") == f, F.lit(least[f])), fields, F)
    work = cut(df.select(doc, *fields))
    common = items_per_field(work, fields, doc).filter(F.col("n") >= bound).select("field", "item")
    kept = lookup_join(explode_fields(work, fields, doc), common, ["field", "item"])
    return _back(df, _regroup(work, kept, fields, doc), fields, doc)


def shuffle_documents(df: DataFrame, seed: int = 0, doc: str = DOC) -> DataFrame:
    """Documents in a reproducible random order."""
    return df.withColumn("shuffle_key", sample_key(doc, seed=seed)).orderBy("shuffle_key", doc)


def without_empty(df: DataFrame, kind: str, doc: str = DOC) -> DataFrame:
    """Documents that take part for one kind of data; the others are unclassified by that kind only."""
    return non_empty(df, kind).select(doc, kind)
