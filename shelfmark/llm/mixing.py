"""Mixing sources to target weights.

Every document gets a hash-random key; rows are cut into key ranges within their source, prefix sums of sizes run
first over the ranges and then inside each, and a source's budget is cut at the exact word. Budgets above a source's
size repeat it (epochs).

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id is hashed as the
empty text; rows equal in id and size share their key and are ordered among themselves arbitrarily, which does not
change the set of result rows; an empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc: str, seed: int = 0) -> Column:
    """Uniform 60-bit number per id, from md5 so that any engine can repeat it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def source_targets(sources: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Target of each source. ``sources``: source, source_size, one row each.

    Weights repeat along the sources in code-point order. The excess of a source above ``cap`` times its size goes to
    the others by weight until none is above: each round is one small aggregate over the table of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # one row per source: the only global order of this operator
    table = sources.withColumn("_at", F.row_number().over(order) - 1)
    table = table.withColumn("_w", F.element_at(cycle, (F.col("_at") % len(weights) + 1).cast("int")))
    table = saved(table.withColumn("_most", F.col("source_size") * F.lit(float(cap))).drop("_at"), "sources")
    total = table.agg(F.sum("source_size")).first()[0]
    budget, level = float(share) * (total or 0), -1.0
    while True:
        full = (F.col("_w") * F.lit(level)) > F.col("_most")
        if level < 0:
            full = F.lit(False)
        row = table.agg(
            F.sum(F.when(full, F.col("_most")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("open"),
        ).first()
        new = (budget - row["capped"]) / row["open"] if row["open"] else level
        if new <= level or not row["open"]:
            break
        level = new
    target = F.least(F.col("_most"), F.col("_w") * F.lit(max(level, 0.0)))
    return table.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    doc: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    range_rows: int = 4096,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes.

    A source takes whole passes over all its documents, then documents in key order up to its exact rounded target;
    the document at the cut is taken in part. ``range_rows`` is the mean number of rows that one task orders.
    """
    sizes = docs.select(F.col(doc).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    sizes = saved(sizes.withColumn("_key", random_key("doc_id", seed)), "sizes")
    per_source = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")), "per_source")
    targets = source_targets(per_source.select("source", "source_size"), list(weights), share, cap)
    budget = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(cap)))).cast("long")
    per_source = (
        per_source.join(targets.drop("source_size"), per_source["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("_budget", budget)
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)))
        .withColumn("_rest", F.col("_budget") - F.col("_passes") * F.col("source_size"))
        # enough equal key ranges for range_rows rows each
        .withColumn("_ranges", F.ceil(F.col("_n") / F.lit(range_rows)).cast("long"))
    )
    # _ranges depends on the source alone, so a range is a function of source and key; key >> 20 avoids overflow
    width = F.expr(f"(shiftright(_key, 20) * _ranges) div {1 << (KEY_BITS - 20)}L")
    named = per_source.select(F.col("source").alias("_s"), "source_size", "target", "_passes", "_rest", "_ranges")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_range", width)
    rows = saved(rows.drop("_ranges"), "ranges")
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = saved(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0))), "sums")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    left = F.col("_rest") - F.col("_before") - F.col("_inside")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    taken = (F.col("_passes") * F.col("size") + part).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
