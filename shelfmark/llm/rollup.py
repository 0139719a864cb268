"""Delta-maintained rollups of token counts by source, language and tokenizer version.

Changes (inserts, deletes, revised counts) become signed deltas, which are summed per group before they are stored.
Totals are the sum of the deltas of all committed batches, so they are additive and never need the documents again.
A batch is stored under its id and becomes visible with a marker that is written last: a failed attempt leaves nothing
visible and is overwritten by the next one, and a batch that is committed is never applied twice.

Defined cases: null source, language, tokenizer are groups of their own; null counts are 0; a change with no old image
is an insert, with no new image a delete, with both a revision, with neither nothing; repeated change rows count each;
groups that have come down to no documents and no tokens are not listed; empty batches can be committed; columns other
than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
IMAGE = "struct<source: string, lang: string, tokenizer: string, tokens: bigint>"
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def image(source: Column, lang: Column, tokenizer: Column, tokens: Column) -> Column:
    """The state of one count before or after a change."""
    return F.struct(source.alias("source"), lang.alias("lang"), tokenizer.alias("tokenizer"), tokens.alias("tokens")).cast(IMAGE)


def no_image() -> Column:
    return F.lit(None).cast(IMAGE)


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Change rows (``old``, ``new`` images) summed to one signed row per group."""
    signs = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("image"))
    )
    rows = changes.select(F.inline(signs)).filter(F.col("image").isNotNull())
    rows = rows.select("sign", *[F.col(f"image.{k}").alias(k) for k in KEYS], F.coalesce("image.tokens", F.lit(0)).alias("n"))
    docs, tokens = F.sum("sign").cast("bigint"), F.sum(F.col("sign") * F.col("n")).cast("bigint")
    return rows.groupBy(*KEYS).agg(docs.alias("docs"), tokens.alias("tokens"))


class Rollup:
    """A rollup stored in a shared folder; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self) -> Rollup:
        self.spark.createDataFrame([], "batch string").write.mode("ignore").parquet(f"{self.root}/commits")
        self.spark.createDataFrame([], f"{DELTA}, batch string").write.mode("ignore").parquet(f"{self.root}/deltas/empty")
        return self

    def commits(self) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.root}/commits").distinct()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once. False, and nothing read or written, if the batch has been committed before."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"a batch id is made of letters, digits, - and _: {batch!r}")
        if self.commits().filter(F.col("batch") == batch).count():
            return False
        deltas = signed_deltas(changes).withColumn("batch", F.lit(batch))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/of-{batch}")
        marker = self.spark.createDataFrame([(batch,)], "batch string")
        marker.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over the committed batches."""
        deltas = self.spark.read.schema(f"{DELTA}, batch string").parquet(f"{self.root}/deltas/*")
        live = deltas.join(self.commits(), "batch", "left_semi")
        sums = live.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))
