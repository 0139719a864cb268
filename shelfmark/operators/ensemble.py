"""Combination of several classifiers: weighted confidence, weighted vote, automatic weights, confusion shares.

Scores are ``doc, classifier_id, target, confidence``; weights are ``classifier_id, target, weight``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.evaluate import label_counts, with_prf
from shelfmark.operators.nbest import UNCLASSIFIED
from shelfmark.operators.skew import DOC, salted_join
from shelfmark.session import cut, stored


def above_threshold(scores: DataFrame, thresholds: dict[int, float]) -> DataFrame:
    """Confidences below the classifier's threshold become 0."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("classifier_id")], F.lit(0.0))
    kept = F.when(F.col("confidence") >= limit, F.col("confidence")).otherwise(F.lit(0.0))
    return scores.withColumn("confidence", kept)


def final_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    kept = F.when(F.col("confidence") >= threshold, F.col("confidence")).otherwise(F.lit(0.0))
    return scores.withColumn("confidence", kept)


def weighted_mean(scores: DataFrame, weights: DataFrame, doc: str = DOC, by=()) -> DataFrame:
    """Sum of confidence times weight over classifiers, divided by the weights of *all* classifiers for the target.

    Both tables may have weights' own keys ``by`` (the fold). The divisor is a column of the weight table, so the scores meet one lookup and one aggregate. The class is a hot
    join key by nature (every document scores it), hence the salt.
    """
    totals = weights.groupBy(*by, "target").agg(F.sum("weight").alias("_all"))
    lookup = weights.join(totals, [*by, "target"]).select(*by, "classifier_id", "target", "weight", "_all")
    joined = salted_join(scores, lookup, [*by, "classifier_id", "target"], [doc])
    summed = joined.groupBy(doc, "target").agg(
        F.sum(F.col("confidence") * F.col("weight")).alias("_s"), F.first("_all").alias("_all")
    )
    mean = F.when(F.col("_all") > 0, F.col("_s") / F.col("_all")).otherwise(F.lit(0.0))
    return summed.select(doc, "target", mean.alias("confidence"))


def combine_confidences(
    scores: DataFrame, weights: DataFrame, thresholds: dict[int, float] | None = None, threshold: float = 0.0,
    doc: str = DOC, by=(),
) -> DataFrame:
    """Ensemble by confidence: classifier thresholds, weighted mean, final threshold."""
    if thresholds:
        scores = above_threshold(scores, thresholds)
    return final_threshold(weighted_mean(scores, weights, doc, by), threshold)


def best_votes(scores: DataFrame, thresholds: dict[int, float] | None = None, doc: str = DOC, by=()) -> DataFrame:
    """``doc, classifier_id, predicted``: each classifier's best positive target that reaches its threshold."""
    if thresholds:
        scores = above_threshold(scores, thresholds)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "target")).alias("_best")
    picked = scores.filter(F.col("confidence") > 0).groupBy(doc, "classifier_id", *by).agg(best)
    return picked.select(doc, *by, "classifier_id", F.col("_best.target").alias("predicted"))


def weighted_vote(documents: DataFrame, votes: DataFrame, weights: DataFrame, doc: str = DOC, by=()) -> DataFrame:
    """Target with the largest sum of vote weights; ties go to the lowest classifier, then to the target's name.

    ``votes`` is ``doc, classifier_id, predicted``; a document without votes is unclassified.
    """
    cast = votes.filter(F.col("predicted") != UNCLASSIFIED).select(doc, *by, "classifier_id", F.col("predicted").alias("target"))
    weighed = salted_join(cast, weights, [*by, "classifier_id", "target"], [doc], "left")
    sums = weighed.groupBy(doc, "target").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("_w"), F.min("classifier_id").alias("_c")
    )
    best = F.min(F.struct((-F.col("_w")).alias("w"), "_c", "target")).alias("_best")
    picked = sums.groupBy(doc).agg(best)
    predicted = F.coalesce("_best.target", F.lit(UNCLASSIFIED)).alias("predicted")
    return documents.join(picked, doc, "left").select(*documents.columns, predicted)


def full_grid(documents: DataFrame, scores: DataFrame, targets: list[str], doc: str = DOC) -> DataFrame:
    """A confidence for every document and target, 0 where a classifier has none. The class list is settings-sized."""
    grid = documents.select(doc, F.explode(F.array(*map(F.lit, targets))).alias("target"))
    joined = grid.join(scores.select(doc, "target", "confidence"), [doc, "target"], "left")
    return joined.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def missing_targets(targets: DataFrame, seen: DataFrame) -> DataFrame:
    """Classes a classifier never saw."""
    return targets.select("target").distinct().join(seen.select("target").distinct(), "target", "left_anti")


def automatic_weights(votes: DataFrame, trained: DataFrame, n_targets: int | None = None) -> DataFrame:
    """Weight of classifier and target: mean F1 over folds times the share of all classes the classifier has seen.

    ``votes`` is ``classifier_id, fold, doc, target, predicted``; ``trained`` holds ``classifier_id, target`` for the
    documents the classifier was given. A class missing in a fold is left out of its mean, one never seen weighs 0.
    """
    f1 = with_prf(label_counts(votes, ("classifier_id", "fold"))).groupBy("classifier_id", "target").agg(
        F.avg("f1").alias("_f1")
    )
    seen = trained.groupBy("classifier_id").agg(F.count_distinct("target").alias("_seen"))
    if n_targets is None:
        n_targets = trained.select("target").distinct().count()
    weight = (F.col("_f1") * F.col("_seen") / F.lit(float(n_targets))).alias("weight")
    return f1.join(seen, "classifier_id").select("classifier_id", "target", weight)


def training_report(kinds: DataFrame) -> DataFrame:
    """Documents and classes each classifier is trained on: ``classifier_id, doc, target`` of non-empty documents."""
    return kinds.groupBy("classifier_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_distinct("target").alias("n_targets")
    )


def confusion_shares(pred: DataFrame) -> DataFrame:
    """``predicted, meant, share``: how often a prediction really means each class. Only non-zero cells."""
    cells = pred.groupBy("predicted", F.col("target").alias("meant")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("predicted").agg(F.sum("n").alias("_all"))
    return cells.join(totals, "predicted").select("predicted", "meant", (F.col("n") / F.col("_all")).alias("share"))


def redistribute(scores: DataFrame, shares: DataFrame, doc: str = DOC) -> DataFrame:
    """One redistribution step: each confidence is spread over the classes its prediction stands for."""
    lookup = shares.select(F.col("predicted").alias("target"), "meant", "share")
    positive = scores.filter(F.abs("confidence") > 1e-8)
    spread = salted_join(positive, lookup, ["target"], [doc])
    return spread.groupBy(doc, F.col("meant").alias("target")).agg(
        F.sum(F.col("confidence") * F.col("share")).alias("confidence")
    )


def learn_redistribution(scores: DataFrame, truth: DataFrame, doc: str = DOC, patience: int = 2):
    """Share tables to apply one after another: repeated while held-out accuracy grows, cut back to the best step.

    ``scores`` are held-out confidences ``doc, target, confidence`` and ``truth`` is ``fold, doc, target``.
    Each step is cut, so the loop does not grow the lineage; only accuracies come to the driver.
    """

    def evaluate(s):
        best = F.min(F.struct((-F.col("confidence")).alias("c"), "target")).alias("_best")
        picked = s.groupBy(doc).agg(best).select(doc, F.col("_best.target").alias("predicted"))
        pred = truth.join(picked, doc)
        hit = F.avg((F.col("target") == F.col("predicted")).cast("double")).alias("a")
        return pred, pred.groupBy("fold").agg(hit).agg(F.avg("a")).first()[0] or 0.0

    pred, best_accuracy = evaluate(scores)
    tables, best_count, left = [], 0, patience
    while left > 0 and best_accuracy < 1:
        shares = stored(confusion_shares(pred), "shares")
        tables.append(shares)
        scores = cut(redistribute(scores, shares, doc))
        pred, accuracy = evaluate(scores)
        if accuracy > best_accuracy:
            best_accuracy, best_count, left = accuracy, len(tables), patience
        else:
            left -= 1
    return tables[:best_count]


def apply_redistribution(scores: DataFrame, tables: list[DataFrame], doc: str = DOC) -> DataFrame:
    for shares in tables:
        scores = redistribute(scores, shares, doc)
    return scores
