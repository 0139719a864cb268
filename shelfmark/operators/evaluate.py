"""Metrics over prediction tables ``fold, doc, target, predicted``; '' is no prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import hierarchy
from shelfmark.operators.skew import DOC
from shelfmark.session import bounded_rows

UNCLASSIFIED_LABEL = "(unclassified)"


def classified(pred: DataFrame) -> DataFrame:
    return pred.filter(F.col("predicted") != "")


def unclassified_counts(pred: DataFrame) -> DataFrame:
    """Unclassified documents per fold."""
    return pred.groupBy("fold").agg(F.count_if(F.col("predicted") == "").alias("unclassified"))


def unclassified_summary(pred: DataFrame) -> DataFrame:
    return unclassified_counts(pred).agg(
        F.sum("unclassified").alias("total"), F.avg("unclassified").alias("mean_per_fold")
    )


def label_counts(pred: DataFrame, by=("fold",)) -> DataFrame:
    """True positives, support and predictions per label, over true and predicted labels alike.

    Every document gives two small rows that combine map-side, so a label holding most documents costs one shuffle
    row per task.
    """
    hit = (F.col("target") == F.col("predicted")).cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("target").alias("target"), hit.alias("tp"), one.alias("t"), zero.alias("p")),
        F.struct(F.col("predicted").alias("target"), zero.alias("tp"), zero.alias("t"), one.alias("p")),
    )
    rows = classified(pred).select(*by, F.inline(sides))
    return rows.groupBy(*by, "target").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("n_predicted")
    )


def with_prf(counts: DataFrame) -> DataFrame:
    p = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_predicted") + F.col("support"))).otherwise(F.lit(0.0))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def target_scores(pred: DataFrame, train_counts: DataFrame | None = None, by=("fold",)) -> DataFrame:
    """Precision, recall, F1, support and number of training documents per true target."""
    scores = with_prf(label_counts(pred, by)).filter(F.col("support") > 0).drop("tp", "n_predicted")
    if train_counts is None:
        return scores
    joined = scores.join(train_counts, [*by, "target"], "left")
    return joined.withColumn("n_train", F.coalesce("n_train", F.lit(0)))


def train_counts(pred: DataFrame, folds: int) -> DataFrame:
    """Training documents per fold and target when each fold 0..k-1 is trained on the other folds."""
    own = pred.groupBy("fold", "target").agg(F.count(F.lit(1)).alias("n"))
    return other_folds(own, folds).groupBy("fold", "target").agg(F.sum("n").alias("n_train"))


def other_folds(sums: DataFrame, folds: int) -> DataFrame:
    """Rows of every fold handed to all other folds; ``fold`` becomes the fold they train.

    Meant for pre-aggregated rows, where the (k-1)-fold copy is small.
    """
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array(F.col("fold").cast("int")))
    return sums.withColumn("fold", F.explode(others))


def average_scores(pred: DataFrame) -> DataFrame:
    """Micro, macro and support-weighted precision, recall and F1 per fold, over true and predicted labels."""
    s = with_prf(label_counts(pred))
    total = F.sum("support")
    micro = F.sum("tp") / total
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    kinds = s.groupBy("fold").agg(
        F.array(
            F.struct(F.lit("micro").alias("average"), micro.alias("precision"), micro.alias("recall"), micro.alias("f1")),
            F.struct(F.lit("macro").alias("average"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1")),
            F.struct(F.lit("weighted (support)").alias("average"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1")),
        ).alias("_k")
    )
    return kinds.select("fold", F.inline("_k"))


def cross_fold_means(scores: DataFrame, key: str = "target") -> DataFrame:
    """Means over folds; a target missing in a fold is left out of its mean."""
    values = [c for c in scores.columns if c not in ("fold", key)]
    return scores.groupBy(key).agg(*[F.avg(c).alias(c) for c in values])


def top_n_accuracy(
    pred: DataFrame, candidates: DataFrame, n: int, delimiter: str = hierarchy.HIERARCHY_DELIMITER, doc: str = DOC
) -> DataFrame:
    """Share of classified documents whose first 1..n candidates hold the target: exact, direct family, family, same
    top level. ``candidates`` is ``doc, target, rank``."""
    pairs = classified(pred).select("fold", doc, "target").join(
        candidates.select(doc, F.col("target").alias("candidate"), "rank"), doc
    )
    exact = F.col("target") == F.col("candidate")
    a, b = F.col("candidate"), F.col("target")
    direct = exact | hierarchy.direct_family(a, b, delimiter)
    family = direct | hierarchy.same_family(a, b, delimiter)
    top = family | hierarchy.same_top_level(a, b, delimiter)
    tests = {"exact match": exact, "direct family": direct, "family": family, "same top level": top}
    first = [F.min(F.when(test, F.col("rank"))).alias(name) for name, test in tests.items()]
    per_doc = pairs.groupBy("fold", doc).agg(*first)
    shares = [
        F.struct(F.lit(k).alias("n"), F.lit(name).alias("level"),
                 F.avg((F.coalesce(F.col(name), F.lit(n + 1)) <= k).cast("double")).alias("accuracy"))
        for k in range(1, n + 1)
        for name in tests
    ]
    return per_doc.groupBy("fold").agg(F.array(*shares).alias("_s")).select("fold", F.inline("_s"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """Long confusion matrix with margins, marked ``All``; unclassified documents have their own label."""
    label = F.when(F.col("predicted") == "", F.lit(UNCLASSIFIED_LABEL)).otherwise(F.col("predicted"))
    rows = pred.groupBy("target", label.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    cells = rows.cube("target", "predicted").agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
    return cells.select(
        F.when(F.col("_g").isin(2, 3), F.lit("All")).otherwise(F.col("target")).alias("target"),
        F.when(F.col("_g").isin(1, 3), F.lit("All")).otherwise(F.col("predicted")).alias("predicted"),
        "n",
    )


def wide_confusion_matrix(pred: DataFrame, max_columns: int = 10_000) -> DataFrame:
    """Confusion matrix with one column per predicted label; the label list is settings-sized and checked."""
    cells = confusion_matrix(pred)
    labels = [r[0] for r in bounded_rows(cells.select("predicted").distinct().orderBy("predicted"), max_columns, "labels")]
    columns = [F.coalesce(F.sum(F.when(F.col("predicted") == x, F.col("n"))), F.lit(0)).alias(x) for x in labels]
    return cells.groupBy("target").agg(*columns)


def match_flags(pred: DataFrame) -> DataFrame:
    return pred.withColumn("match", F.col("predicted").eqNullSafe(F.col("target")).cast("int"))
