"""Ranks, indexes and joins that never gather one hot key in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import cut

DOC = "doc_idx"
BLOCK_ROWS = 1 << 18
MAX_CUTS = 4096


def sample_key(*columns: str, seed: int = 0) -> Column:
    """Deterministic uniform 60-bit number per row, the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def id_block(doc: str = DOC, rows: int = BLOCK_ROWS) -> Column:
    """Order-preserving block of a numeric document id."""
    return F.expr(f"`{doc}` div {int(rows)}")


def with_id_block(df: DataFrame, doc: str = DOC, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` and ``_block``, which never decreases along the numeric id ``doc``: about ``rows`` rows per block.

    Ids without large gaps are divided (one aggregate tells). Others are cut at their quantiles, which a sketch estimates
    and a binary search looks up; at most ``MAX_CUTS`` numbers come to the driver, blocks grow beyond that.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("low"), F.max(doc).alias("high")).first()
    wanted = seen["n"] // rows + 1
    if seen["low"] is None or int(seen["high"]) // rows - int(seen["low"]) // rows <= 2 * wanted:
        return df.withColumn("_block", id_block(doc, rows))
    n = min(wanted, MAX_CUTS)
    at = df.select(F.col(doc).cast("double").alias("_at")).stat.approxQuantile("_at", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted(set(at))
    blocks = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=doc, outputCol="_block")
    return blocks.transform(df) if cuts else df.withColumn("_block", F.lit(0.0))


def key_block(key: str, bits: int = 12) -> Column:
    """Order-preserving block of a :func:`sample_key`: its highest bits."""
    return F.shiftright(F.col(key), 60 - bits)


def blocked_rank(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | int,
    name: str = "rank",
    total: str | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """1-based rank of every row within ``keys`` by ``order``.

    ``block`` must not decrease along ``order``; a number stands for blocks of about that many rows by the id ``order[0]``,
    however the ids are spread. A hot key is spread over its blocks: the rank is the number of rows
    in earlier blocks plus the rank inside the block, so one task never holds more than one block of one key. Only
    the block counts (pre-aggregated, one row per key and block) are summed along the key. ``per_key`` adds columns
    that depend on the key alone; they ride on the counts instead of on the rows.
    """
    df = with_id_block(df, order[0], block) if isinstance(block, int) else df.withColumn("_block", block)
    counts = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*(keys or [F.lit(0)]))
    counts = counts.withColumn("_before", F.sum("_n").over(along.orderBy("_block")) - F.col("_n"))
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(along))
    if per_key is not None:
        counts = counts.join(per_key, keys)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        df.join(counts.drop("_n"), [*keys, "_block"])
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_block", "_before")
    )


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position of every row along a global order, without a single-task sort.

    The range-sorted rows are cut first, so partition numbers are fixed; the offsets are then one row per partition.
    """
    rows = cut(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    # one row per partition of the sorted table
    return (
        rows.join(F.broadcast(parts.drop("_n")), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_before")
    )


def exploded(df: DataFrame, keep: list[str], array: str | Column, *names: str, kind: str = "explode") -> DataFrame:
    """``keep`` and one row per array element; ``kind`` is explode, posexplode or inline.

    The outer form with a filter behind it is used on purpose: for the inner form the optimizer infers a filter on the
    array's size, which computes an expensive array (a tokenised text) three times instead of once.
    """
    generate = {"explode": F.explode_outer, "posexplode": F.posexplode_outer, "inline": F.inline_outer}[kind]
    return df.select(*keep, generate(array).alias(*names)).filter(F.col(names[0]).isNotNull())


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], spread_by: list[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join ``rows`` with a settings-sized lookup (classes, weights) whose keys are hot by nature.

    Each key of ``rows`` is spread over ``salts`` tasks (the session's shuffle partitions if not given) and the lookup is
    repeated that often. No broadcast is forced: adaptive execution broadcasts the lookup when its measured size allows,
    and joins by shuffle otherwise.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with a large lookup (vocabulary, lexicon, term table) on a key that may be hot in ``rows``.

    The rows come pre-aggregated, one per document and key. Adaptive execution does the rest at run time: it
    broadcasts the lookup when its measured size allows, and in the shuffled join it splits the partition of a hot
    key over many tasks (inner and left joins). Nothing that follows needs this join's partitioning, so the split is
    never given up. A lookup that was aggregated by the key would be joined in the aggregate's own partitions, where
    there is no shuffle to split; the key's hash as a further join column gives both sides a shuffle of their own.
    """
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        raise RuntimeError("spark.sql.adaptive.enabled must be on: hot join keys are split by adaptive execution")
    key = F.xxhash64(*on)
    return rows.withColumn("_key_hash", key).join(lookup.withColumn("_key_hash", key), [*on, "_key_hash"], how).drop("_key_hash")
