"""Class centroids and the k-means classifier. Centres and class x cluster tables stay distributed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfmark.operators.skew import DOC, sample_key
from shelfmark.session import stored

CHUNK_ROWS = 1 << 15


def centroids(vectors: DataFrame, labels: DataFrame, doc: str = DOC) -> DataFrame:
    """``target, pos, value`` of dense vectors. Sums combine map-side, so a large class costs nothing extra."""
    rows = vectors.select(doc, "vector").join(labels.select(doc, "target"), doc).select("target", F.posexplode("vector").alias("pos", "x"))
    return rows.groupBy("target", "pos").agg(F.avg("x").alias("value"))


def term_centroids(terms: DataFrame, docs: DataFrame, doc: str = DOC) -> DataFrame:
    """``target, term, value`` of sparse vectors: sum over the class divided by its number of documents."""
    sums = terms.join(docs.select(doc, "target"), doc).groupBy("target", "term").agg(F.sum("value").alias("s"))
    sizes = docs.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(sizes, "target").select("target", "term", (F.col("s") / F.col("n")).alias("value"))


def _matrix(vectors) -> np.ndarray:
    rows = list(vectors)
    return np.vstack(rows).astype(float) if rows else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((a - centre) ** 2).sum(1)) for centre in b], axis=1)


def _against(rows: DataFrame, key: str, centres: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows, centres)`` on chunks of ``rows``; each chunk gets its copy of the centres by the shuffle."""
    n = rows.count() // CHUNK_ROWS + 1
    copies = centres.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    chunked = rows.withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))

    def each(mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or given.empty:
            return pd.DataFrame({part.split()[0].strip("`"): pd.Series(dtype=object) for part in schema.split(", ")})
        return run(mine, given)

    return chunked.groupBy("_chunk").cogroup(copies.groupBy("_chunk")).applyInPandas(each, schema)


def nearest_clusters(centres: DataFrame, free: DataFrame) -> DataFrame:
    """``target, cluster, distance, rank`` of every class against the free clusters; ties go to the lower cluster."""

    def measure(mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        d = _distances(_matrix(mine["vector"]), _matrix(given["vector"]))
        return pd.DataFrame({
            "target": np.repeat(mine["target"].to_numpy(), len(given)), "cluster": np.tile(given["cluster"].to_numpy(), len(mine)),
            "distance": d.ravel(),
        })

    rows = _against(centres.select("target", "vector"), "target", free.select("cluster", "vector"), measure, "target string, cluster int, distance double")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("distance", "cluster")))


def cluster_counts(assigned: DataFrame) -> DataFrame:
    """Documents per class and cluster."""
    return assigned.groupBy("target", "cluster").agg(F.count(F.lit(1)).alias("n"))


def stable_matching(wishes: DataFrame) -> DataFrame:
    """``target, cluster`` from ``target, cluster, wish, claim``: deferred acceptance, all classes at once in every round.

    Each class asks for the cluster of its least ``wish`` (ties: lower cluster) that has not refused it; a cluster keeps the
    asker of least ``claim`` (ties: lower name) and refuses the others. The result does not depend on the order of asking.
    """
    place = F.row_number().over(Window.partitionBy("target").orderBy("wish", "cluster"))
    left = stored(wishes.select("target", "cluster", "claim", place.alias("place")), "wishes")
    while True:
        asked = left.groupBy("target").agg(F.min(F.struct("place", "cluster", "claim")).alias("_a")).select("target", "_a.*")
        ranked = asked.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("claim", "target")))
        seen = Observation()
        ranked = stored(ranked.observe(seen, F.max("rank").alias("most")), "asked")
        if (seen.get["most"] or 0) <= 1:
            return ranked.select("target", "cluster")
        left = stored(left.join(ranked.filter("rank > 1").select("target", "place"), ["target", "place"], "left_anti"), "wishes")


def match_clusters(counts: DataFrame, distances: DataFrame) -> DataFrame:
    """``target, cluster``: one cluster per class, from ``target, cluster, n`` and ``target, cluster, distance``.

    Each class wants its most frequent cluster; a contested cluster goes to the class with more documents in it and
    the loser moves on to its next cluster. Classes that run out share the clusters nobody holds by nearness. Classes of
    ``distances`` without documents take part in the second turn only; a class for which no cluster is left has no row.
    """
    held = stable_matching(counts.select("target", "cluster", (-F.col("n")).alias("wish"), (-F.col("n")).alias("claim")))
    free = distances.join(held, "target", "left_anti").join(held, "cluster", "left_anti")
    return held.unionByName(stable_matching(free.select("target", "cluster", F.col("distance").alias("wish"), F.col("distance").alias("claim"))))


def hashed_seeds(vectors: DataFrame, k: int, seed: int = 0, doc: str = DOC) -> DataFrame:
    """``cluster, vector``: the ``k`` vectors of least hash of their ids, numbered in that order."""
    least = vectors.select(doc, "vector", sample_key(doc, seed=seed).alias("_key")).orderBy("_key", doc).limit(k)
    return least.select((F.row_number().over(Window.orderBy("_key", doc)) - 1).alias("cluster"), "vector")  # k rows


def _assign(mine: pd.DataFrame, centres: pd.DataFrame) -> np.ndarray:
    """Position of the nearest centre of every row; ties go to the first."""
    matrix, x = _matrix(centres["vector"]), _matrix(mine["vector"])
    step = max(1, (1 << 22) // len(matrix))
    return np.concatenate([_distances(x[i:i + step], matrix).argmin(1) for i in range(0, len(x), step)])


def lloyd(vectors: DataFrame, seeds: DataFrame, iterations: int = 20, doc: str = DOC) -> DataFrame:
    """``cluster, vector`` after Lloyd steps from the seeds; a cluster that loses all its rows keeps its centre.

    A step sums each chunk's rows per centre inside the task and the sums of all chunks per centre and position; the steps
    end early once no centre moves.
    """
    rows = vectors.select(doc, "vector")

    def sums(mine: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        centres = centres.sort_values("cluster")
        x, at = _matrix(mine["vector"]), _assign(mine, centres)
        used, place = np.unique(at, return_inverse=True)
        total = np.zeros((len(used), x.shape[1]))
        np.add.at(total, place, x)
        return pd.DataFrame({
            "cluster": np.repeat(centres["cluster"].to_numpy()[used], x.shape[1]), "pos": np.tile(np.arange(x.shape[1]), len(used)),
            "total": total.ravel(), "n": np.repeat(np.bincount(place), x.shape[1]),
        })

    centres = stored(seeds.select(F.col("cluster").cast("int").alias("cluster"), "vector"), "centres")
    for _ in range(iterations):
        parts = _against(rows, doc, centres, sums, "cluster int, pos int, total double, n bigint")
        means = parts.groupBy("cluster", "pos").agg((F.sum("total") / F.sum("n")).alias("value"))
        means = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_c")).select("cluster", F.col("_c.value").alias("mean"))
        new = centres.join(means, "cluster", "left").select("cluster", F.coalesce("mean", "vector").alias("vector"), "vector").toDF("cluster", "vector", "old")
        gaps = F.zip_with("vector", "old", lambda a, b: F.abs(a - b))
        seen = Observation()
        centres = stored(new.observe(seen, F.max(F.array_max(gaps)).alias("moved")).drop("old"), "centres")
        if (seen.get["moved"] or 0.0) == 0.0:
            break
    return centres


def assigned_clusters(vectors: DataFrame, centres: DataFrame, doc: str = DOC) -> DataFrame:
    """``doc, cluster``: the nearest centre of every row."""

    def nearest(mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("cluster")
        return pd.DataFrame({doc: mine[doc].to_numpy(), "cluster": given["cluster"].to_numpy()[_assign(mine, given)]})

    return _against(vectors.select(doc, "vector"), doc, centres, nearest, f"`{doc}` bigint, cluster int")


def fit_kmeans(
    vectors: DataFrame, labels: DataFrame, seed: int = 0, iterations: int = 20, doc: str = DOC, seeds: DataFrame | None = None
) -> DataFrame:
    """``target, cluster, vector``: k-means with one cluster per class, each cluster given to one class.

    ``seeds`` (``cluster, vector``) are the first centres, :func:`hashed_seeds` where none are given. Where there are
    fewer rows than classes, some classes get no cluster; of no rows comes no cluster.
    """
    labels = labels.filter(F.col("target").isNotNull())
    train = stored(vectors.select(doc, "vector").join(labels.select(doc, "target"), doc), "train")
    if seeds is None:
        seeds = hashed_seeds(train, train.select("target").distinct().count(), seed, doc)
    centres = lloyd(train, seeds, iterations, doc)
    counts = cluster_counts(assigned_clusters(train, centres, doc).join(train.select(doc, "target"), doc))
    means = centroids(train, train, doc).groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_c")
    ).select("target", F.col("_c.value").alias("vector"))
    matched = match_clusters(counts, nearest_clusters(means, centres))
    return centres.join(matched, "cluster", "left").select("target", "cluster", "vector")


def score_kmeans(clusters: DataFrame, vectors: DataFrame, doc: str = DOC) -> DataFrame:
    """``doc, target, confidence`` in inverse proportion to the distance; an exact hit takes everything."""

    def score(mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        d = _distances(_matrix(mine["vector"]), _matrix(given["vector"]))
        hit = d == 0
        weight = np.where(hit.any(1)[:, None], hit.astype(float), 1.0 / np.where(hit, 1.0, d))
        share = weight / weight.sum(1)[:, None]
        return pd.DataFrame({
            doc: np.repeat(mine[doc].to_numpy(), len(given)), "target": np.tile(given["target"].to_numpy(), len(mine)), "confidence": share.ravel(),
        })

    named = clusters.filter(F.col("target").isNotNull()).select("target", "vector")
    return _against(vectors.select(doc, "vector"), doc, named, score, f"`{doc}` bigint, target string, confidence double")
