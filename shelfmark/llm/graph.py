"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """id, label: each id of ``links`` (columns a, b) with the least id that it is connected to.

    Labels spread along links and then jump to the label of their label, until none changes: the number of rounds grows
    with the logarithm of a component's width. Every table of a round is written, so lineage stays short; sums by id are
    made before the shuffle, and both sides of the joins are plain scans, so that adaptive execution can split a hub.
    """
    both = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = saved(labels, "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("id")).groupBy(F.col("b").alias("_b")).agg(F.min("label").alias("_near"))
        step = labels.join(near, F.col("id") == F.col("_b"), "left")
        step = step.select("id", F.col("label").alias("old"), F.least("label", "_near").alias("label"))
        step = saved(step, "spread")
        if not step.filter("old <> label").limit(1).count():
            return step.select("id", "label")
        of = step.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        jump = step.join(of, step["label"] == of["_id"], "left").select("id", F.least("label", "_label").alias("label"))
        labels = saved(jump, "labels")
