import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import bayes, clusters, embeddings, ensemble, filters, linear, nbest, neighbours, ridge, sampling, skew, sparse_neighbours, splits
from shelfmark.operators.skew import DOC, lookup_join
from shelfmark.plans import commands
from shelfmark.plans.commands import Classifier
from shelfmark.sources import relational, store


def brute_max(docs, quotas, columns):
    counts = {f: {} for f in quotas}
    for _, d in docs:
        for f in quotas:
            for x in d[f] or []:
                counts[f][x] = counts[f].get(x, 0) + 1
    left = {f: {x: int(n * quotas[f] + 0.5) if isinstance(quotas[f], float) else min(n, quotas[f]) for x, n in c.items()}
            for f, c in counts.items()}
    out = {}
    for i, d in docs:
        row, skip = {}, False
        for f in columns:
            kept = []
            for x in d[f] or []:
                if left[f][x] > 0:
                    left[f][x] -= 1
                    kept.append(x)
            if d[f] and not kept:
                skip = True
                break
            row[f] = kept or None
        if not skip:
            out[i] = row
    return out


@pytest.mark.parametrize("seed", range(3))
def test_max_per_item_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    docs = [(i, {f: rnd.choices("aaab" if f == "p" else "xyz", k=rnd.randint(0, 3)) for f in "pq"}) for i in range(0, 120, 2)]
    quotas = {"p": 9, "q": 0.4}
    df = spark.createDataFrame([(i, d["p"], d["q"]) for i, d in docs], f"{DOC} bigint, p array<string>, q array<string>")
    for width in (1, 16, 1000):  # the same result whatever the blocks
        got = {r[DOC]: {"p": r.p, "q": r.q} for r in filters.max_per_item(df, quotas, block_rows=width).collect()}
        assert got == brute_max(docs, quotas, ["p", "q"])


def test_blocked_rank_with_one_hot_key(spark):
    df = spark.range(3000).select(F.col("id").alias(DOC), F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("target"))
    got = skew.blocked_rank(df, ["target"], [DOC], skew.id_block(DOC, 64), total="n").collect()
    by_key = {}
    for r in sorted(got, key=lambda r: r[DOC]):
        by_key.setdefault(r.target, []).append(r["rank"])
    assert by_key == {"hot": list(range(1, 2001)), "cold": list(range(1, 1001))}


@pytest.mark.parametrize("factor", [1, 1 << 40, -(1 << 40)])
def test_blocked_rank_of_sparse_ids(spark, factor):
    df = spark.range(3000).select((F.col("id") * factor).alias(DOC), F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("target"))
    sizes = [r["count"] for r in skew.with_id_block(df, DOC, 100).groupBy("_block").count().collect()]
    assert len(sizes) <= 32 and max(sizes) <= 200
    got = skew.blocked_rank(df, ["target"], [DOC], 100).collect()
    for key, n in (("hot", 2000), ("cold", 1000)):
        assert [r["rank"] for r in sorted(got, key=lambda r: r[DOC]) if r["target"] == key] == list(range(1, n + 1))


def test_dense_index_is_independent_of_partitions(spark):
    rows = [(f"w{i:04d}",) for i in random.Random(1).sample(range(5000), 800)]
    for n in (1, 4, 16):
        got = skew.dense_index(spark.createDataFrame(rows, "term string").repartition(n), ["term"], "index").collect()
        assert [r.term for r in sorted(got, key=lambda r: r["index"])] == sorted(r[0] for r in rows)
        assert sorted(r["index"] for r in got) == list(range(800))


def test_folds_sampling_sizes(spark):
    df = spark.range(100).select(F.col("id").alias(DOC), F.when(F.col("id") < 70, "a").when(F.col("id") < 98, "b").otherwise("c").alias("target"))
    sizes = {(r.target, r.fold): r["count"] for r in splits.stratified_folds(df, 3, block_rows=8).groupBy("target", "fold").count().collect()}
    assert sizes == {("a", 0): 24, ("a", 1): 23, ("a", 2): 23, ("b", 0): 10, ("b", 1): 9, ("b", 2): 9, ("c", 0): 1, ("c", 1): 1}
    over = sampling.over_sample(df, 1.0, 3)
    assert {r.target: r["count"] for r in over.groupBy("target").count().collect()} == {"a": 70, "b": 70, "c": 70}
    assert over.select(DOC, "copy").distinct().count() == 210
    under = sampling.under_sample(df, 0.25, 3)
    assert {r.target: r["count"] for r in under.groupBy("target").count().collect()} == {"a": 18, "b": 18, "c": 2}
    with pytest.raises(ValueError):
        splits.leave_one_out(df, limit=50)


def test_neighbours_are_exact_with_hot_cells_and_copies(spark):
    rnd = np.random.default_rng(0)
    points = np.vstack([rnd.normal(0, 0.01, (300, 4)), rnd.normal(3, 1, (200, 4)), np.zeros((40, 4))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], f"{DOC} bigint, vector array<double>")
    for pivots in (1, 12):
        got = neighbours.nearest_neighbours(df, df, 3, pivots=pivots, exclude_self=True, test_chunk=64, train_chunk=100).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r[DOC], r["rank"])):
            found.setdefault(r[DOC], []).append(r.neighbour)
        for i, p in enumerate(points):
            d = np.sqrt(((points - p) ** 2).sum(1))
            order = [j for j in np.lexsort((np.arange(len(points)), d)) if j != i][:3]
            assert found[i] == order, (pivots, i)


def matched(spark, counts, distances):
    counts = spark.createDataFrame(counts, "target string, cluster int, n bigint")
    distances = spark.createDataFrame(distances, "target string, cluster int, distance double")
    return {r["cluster"]: r["target"] for r in clusters.match_clusters(counts, distances).collect()}


def test_cluster_matching_resolves_conflicts(spark):
    # both classes prefer cluster 0; b has more documents in it, a moves on
    near = [("a", 0, 0.0), ("a", 1, 1.0), ("b", 0, 0.0), ("b", 1, 1.0)]
    assert matched(spark, [("a", 0, 5), ("a", 1, 2), ("b", 0, 9), ("b", 1, 1)], near) == {0: "b", 1: "a"}
    # a class that runs out takes the nearest free cluster
    assert matched(spark, [("a", 0, 1), ("b", 0, 9)], [("a", 0, 0.0), ("a", 2, 1.0), ("a", 1, 2.0), ("b", 0, 0.0)]) == {0: "b", 2: "a"}


@pytest.mark.parametrize("seed", range(2))
def test_cluster_matching_is_stable(spark, seed):
    rnd = random.Random(seed)
    counts = [(t, c, rnd.randrange(1, 5)) for t in "abcdefg" for c in range(7) if rnd.random() < 0.5]  # with ties
    got = matched(spark, counts, [(t, c, rnd.random()) for t in "abcdefg" for c in range(7)])
    assert sorted(got.values()) == list("abcdefg")  # as many clusters as classes: everyone gets one
    n = {(t, c): k for t, c, k in counts}
    own = {t: c for c, t in got.items()}
    for t, c, k in counts:  # nobody prefers a cluster that would rather have them
        better = (-k, c) < (-n.get((t, own[t]), 0), own[t])
        assert not (better and (-k, t) < (-n.get((got[c], c), 0), got[c]))


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_lloyd_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(clusters, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (20, 3)) for c in (0, 4, 9)] + [np.zeros((15, 3))])  # with copies
    seeds = np.vstack([x[[0, 1, 25]], [[99.0, 99.0, 99.0]]])  # the last one stays empty and keeps its centre
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{DOC} bigint, vector array<double>")
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(seeds)], "cluster int, vector array<double>")
    want = seeds.copy()
    for _ in range(6):
        at = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
        want = np.array([x[at == c].mean(0) if (at == c).any() else want[c] for c in range(4)])
    got = {r["cluster"]: r["vector"] for r in clusters.lloyd(vectors, given, 6).collect()}
    assert got == {c: pytest.approx(want[c].tolist()) for c in range(4)}


def test_kmeans_of_nothing(spark):
    none = spark.createDataFrame([], f"{DOC} bigint, vector array<double>, target string")
    fitted = clusters.fit_kmeans(none, none)
    assert fitted.collect() == [] and clusters.score_kmeans(fitted, none).collect() == []


@pytest.mark.parametrize("loss", ["perceptron", "squared_loss", "huber", "epsilon_insensitive", "squared_epsilon_insensitive"])
def test_every_loss_separates_two_classes(spark, loss):
    rows = [(0, i, "a" if i % 2 else "b") for i in range(12)]
    docs = spark.createDataFrame(rows, f"fold int, {DOC} bigint, target string")
    terms = docs.select("fold", DOC, F.col("target").alias("term"), F.lit(1.0).alias("value"))
    margins = linear.margins(linear.fit(terms, docs, loss, steps=3), linear.with_bias(terms, docs))
    best = margins.groupBy(DOC).agg(F.max_by("target", "margin").alias("p")).join(docs, DOC)
    assert best.filter("p <> target").count() == 0


def brute_fit(rows, targets, slope, steps=4, penalty=1e-3, rate=0.5):
    classes, names = sorted({t for t in targets if t is not None}), sorted({t for r in rows for t in r})
    x = np.array([[r.get(t, 0.0) for t in names] + [1.0] for r in rows])
    y = np.array([[1.0 if t == c else -1.0 for c in classes] for t in targets])
    w = last = np.zeros((x.shape[1], len(classes)))
    for step in range(1, steps + 1):
        at = w + (step - 1) / (step + 2) * (w - last)
        w, last = at - rate * (penalty * at + x.T @ slope(x @ at, y) / len(rows)), w
    return {(t, c): w[i, j] for i, t in enumerate([*names, linear.BIAS]) for j, c in enumerate(classes)}


@pytest.mark.parametrize(("cells", "block", "parts"), [(1 << 16, 32, 1), (40, 2, 7), (1, 1, 3)])
def test_linear_fit_against_brute_force(spark, monkeypatch, cells, block, parts):
    """Chunks, class blocks and partitions change nothing; models of one fit differ in documents and loss."""
    monkeypatch.setattr(linear, "CHUNK_CELLS", cells)
    monkeypatch.setattr(linear, "CLASS_BLOCK", block)
    rnd = random.Random(5)
    rows = [{f"t{min(rnd.randrange(9), 3)}": 1.0 + rnd.random() for _ in range(rnd.randrange(5))} for _ in range(40)]  # t3 is hot, some are empty
    targets = [rnd.choice([*"aaabcde", None]) for _ in rows]
    slopes = {"squared_hinge": lambda m, y: np.where(y * m < 1, -2 * y * (1 - y * m), 0), "log": lambda m, y: -y / (1 + np.exp(y * m))}
    sets = {"squared_hinge": range(0, 40), "log": range(0, 40, 3)}
    docs = spark.createDataFrame([(f, i, targets[i]) for f, ids in sets.items() for i in ids], f"fold string, {DOC} bigint, target string")
    terms = spark.createDataFrame(
        [(f, i, t, v) for f, ids in sets.items() for i in ids for t, v in rows[i].items()], f"fold string, {DOC} bigint, term string, value double")
    fitted = linear.fit(terms.repartition(parts), docs.repartition(parts), {f: f for f in sets}, steps=4).collect()
    for f, ids in sets.items():
        want = brute_fit([rows[i] for i in ids], [targets[i] for i in ids], slopes[f])
        got = {(r["term"], r["target"]): r["weight"] for r in fitted if r["fold"] == f}
        assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def brute_epochs(rows, ids, targets, slope, chunks, batches, epochs, penalty=1e-3, rate=0.5):
    """Local walks over mini-batches of every chunk, averaged by documents, on dense matrices."""
    classes, names = sorted({t for t in targets if t is not None}), sorted({t for r in rows for t in r})
    x = np.array([[r.get(t, 0.0) for t in names] + [1.0] for r in rows])
    y = np.array([[1.0 if t == c else -1.0 for c in classes] for t in targets])
    digits = [hashlib.md5(str(i).encode()).hexdigest() for i in ids]
    chunk, turn = np.array([int(d[:7], 16) % chunks for d in digits]), np.array([int(d[7:14], 16) % batches for d in digits])
    w = np.zeros((x.shape[1], len(classes)))
    for epoch in range(1, epochs + 1):
        now, mean = rate / epoch**0.5, np.zeros_like(w)
        for c in set(chunk):
            at = w.copy()
            for b in range(batches):
                of = (chunk == c) & (turn == b)
                pull = x[of].T @ slope(x[of] @ at, y[of]) / max(1, of.sum())
                at = at * (1 - now * penalty) - now * pull
            mean += at * (chunk == c).mean()
        w = mean
    return {(t, c): w[i, j] for i, t in enumerate([*names, linear.BIAS]) for j, c in enumerate(classes)}


@pytest.mark.parametrize(("cells", "block", "parts"), [(1 << 16, 32, 1), (30, 2, 7), (30, 2, 2)])
def test_minibatches_against_brute_force(spark, monkeypatch, cells, block, parts):
    """Several chunks, some without a document in a batch; partitions and class blocks change nothing."""
    monkeypatch.setattr(linear, "CHUNK_CELLS", cells)
    monkeypatch.setattr(linear, "CLASS_BLOCK", block)
    rnd = random.Random(6)
    rows = [{f"t{min(rnd.randrange(9), 3)}": 1.0 + rnd.random() for _ in range(rnd.randrange(5))} for _ in range(40)]
    targets = [rnd.choice([*"aaabcde", None]) for _ in rows]
    docs = spark.createDataFrame([(0, i, t) for i, t in enumerate(targets)], f"fold int, {DOC} bigint, target string")
    terms = spark.createDataFrame([(0, i, t, v) for i, r in enumerate(rows) for t, v in r.items()], f"fold int, {DOC} bigint, term string, value double")
    chunks = -(-(len(rows) + sum(map(len, rows))) // cells)
    fitted = linear.fit_stochastic(terms.repartition(parts), docs.repartition(parts), "log", epochs=3, batches=4).collect()
    want = brute_epochs(rows, range(40), targets, lambda m, y: -y / (1 + np.exp(y * m)), chunks, 4, 3)
    assert {(r["term"], r["target"]): r["weight"] for r in fitted} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_minibatches_of_nothing_and_where_they_do_not_apply(spark):
    docs = spark.createDataFrame([], f"fold int, {DOC} bigint, target string")
    terms = spark.createDataFrame([], f"fold int, {DOC} bigint, term string, value double")
    assert linear.fit_stochastic(terms, docs).collect() == []
    for spec in (Classifier("fulltext", "naive_bayes", epochs=2), Classifier("fulltext", "log", epochs=0)):
        with pytest.raises(ValueError, match="epochs"):
            commands.check_specs([spec])
    commands.check_specs([Classifier("fulltext", "log", epochs=2)])


def test_linear_fit_of_nothing_and_of_an_unknown_loss(spark):
    docs = spark.createDataFrame([], f"fold int, {DOC} bigint, target string")
    terms = spark.createDataFrame([], f"fold int, {DOC} bigint, term string, value double")
    assert linear.fit(terms, docs).collect() == []
    with pytest.raises(ValueError, match="unknown loss"):
        linear.fit(terms, docs, "cubic")


@pytest.mark.parametrize(("rows", "block"), [(4096, 64), (7, 2)])
def test_ridge_without_one_equals_training_again(spark, monkeypatch, rows, block):
    """200 documents, some without a target, one class of a single document, repeated vectors."""
    monkeypatch.setattr(ridge, "CHUNK_ROWS", rows)
    monkeypatch.setattr(ridge, "CLASS_BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    x[50:60] = x[50]
    targets = [[*"aaabcd", None][k] for k in rng.integers(0, 7, 199)] + ["single"]
    docs = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, targets))], f"{DOC} bigint, vector array<double>, target string")
    got = {(r[DOC], r["target"]): r["margin"] for r in ridge.leave_one_out(docs, penalty=0.5).collect()}
    wide, classes = np.c_[x, np.ones(200)], sorted({t for t in targets if t})
    assert len(got) == 200 * len(classes)
    for i in range(200):
        rest = np.arange(200) != i
        gram = wide[rest].T @ wide[rest] + 0.5 * np.eye(7)
        for c in classes:
            y = np.array([1.0 if t == c else -1.0 for t in targets])
            assert got[i, c] == pytest.approx(wide[i] @ np.linalg.solve(gram, wide[rest].T @ y[rest]), abs=1e-9)


def test_ridge_of_nothing_and_of_unfit_vectors(spark):
    schema = f"{DOC} bigint, vector array<double>, target string"
    assert ridge.leave_one_out(spark.createDataFrame([], schema)).collect() == []
    for vectors, message in (([[1.0], [1.0, 2.0]], "1 to 2"), ([[0.0] * ridge.MAX_SIZE], "closed form")):
        with pytest.raises(ValueError, match=message):
            ridge.leave_one_out(spark.createDataFrame([(i, v, "a") for i, v in enumerate(vectors)], schema))


@pytest.mark.parametrize("cells", [1 << 14, 9])
def test_embeddings_against_dense_decomposition(spark, monkeypatch, cells):
    monkeypatch.setattr(embeddings, "CHUNK_CELLS", cells)
    rng = np.random.default_rng(11)
    x = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4) + np.outer(np.arange(30) % 3 == 0, np.arange(12) < 4)
    x[[4, 17]] = 0.0  # documents without terms
    x[9] = x[8]
    docs = spark.createDataFrame([(i,) for i in range(30)], f"{DOC} bigint")
    terms = spark.createDataFrame([(i, f"t{j}", float(v)) for (i, j), v in np.ndenumerate(x) if v], f"{DOC} bigint, term string, value double")
    at = lambda size: np.array([r["vector"] for r in sorted(embeddings.document_embeddings(terms, docs, size).collect(), key=lambda r: r[DOC])])
    full, few = at(20), at(4)
    assert np.allclose(full @ full.T, x @ x.T, atol=1e-8)  # no more directions than columns: nothing is lost
    gram = few.T @ few
    assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-8) and not few[[4, 17]].any() and np.allclose(few[8], few[9])
    values = np.linalg.svd(x, compute_uv=False)
    assert np.all(np.diff(np.diag(gram)) <= 1e-9) and np.diag(gram).sum() > 0.97 * (values[:4] ** 2).sum()


def test_embeddings_of_nothing(spark):
    terms = spark.createDataFrame([], f"{DOC} bigint, term string, value double")
    docs = spark.createDataFrame([(7,)], f"{DOC} bigint")
    assert embeddings.document_embeddings(terms, docs, 3).collect()[0]["vector"] == [0.0, 0.0, 0.0]
    assert embeddings.document_embeddings(terms, docs.limit(0), 3).collect() == []


def test_redistribution_stops_at_the_best_step(spark):
    # class b is always scored as a first: the learned shares repair it
    rows = [(i, "a", 0.6 if i < 8 else 0.1) for i in range(12)] + [(i, "b", 0.4 if i < 8 else 0.9) for i in range(12)]
    scores = spark.createDataFrame(rows, f"{DOC} bigint, target string, confidence double")
    truth = spark.createDataFrame([(i % 2, i, "b") for i in range(12)], f"fold int, {DOC} bigint, target string")
    tables = ensemble.learn_redistribution(scores, truth)
    assert len(tables) == 1
    out = ensemble.apply_redistribution(scores, tables)
    assert {r.target for r in out.groupBy(DOC).agg(F.max_by("target", "confidence").alias("target")).collect()} == {"b"}


WORDS = {"greeting": ["hello , friend", "hello there", "good day , friend"], "animal": ["the dog barks", "a cat and a dog", "a cat sleeps"],
         "geometry": ["the square has a side", "a triangle has a side", "the square and the triangle"]}


def small_corpus(spark):
    rows = [(t, text) for t, texts in WORDS.items() for text in texts]
    rows += [(None, "hello friend"), (None, "the cat barks"), (None, "a side of a triangle")]
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], f"{DOC} bigint, target string, fulltext string")


@pytest.mark.parametrize("specs", [
    [Classifier("fulltext", weight="auto")],
    [Classifier("fulltext", "linear_svm")],
    [Classifier("fulltext", weight=0.8), Classifier("fulltext", "neighbours", "hash"), Classifier("fulltext", "match_target", weight=0.1)],
    [Classifier("fulltext", "log", epochs=5)],
], ids=["bayes", "svm", "ensemble", "minibatches"])
def test_small_corpus_end_to_end(spark, tmp_path, specs):
    df = small_corpus(spark)
    kinds = {"fulltext": ("fulltext", "text_ngrams", 1)}
    train = df.filter("target is not null").select(DOC, "target")
    commands.classification(df, train, specs, kinds, str(tmp_path), folds=3)
    report = store.load(spark, str(tmp_path), "report")["report"].collect()
    assert {(r.classifier_id, r.n_docs, r.n_targets) for r in report} == {(i, 9, 3) for i in range(len(specs))}
    got = commands.prediction(df.filter("target is null"), specs, kinds, str(tmp_path), n_best=2, confidence="_c")
    assert got.columns == [DOC, "PREDICTED", "PREDICTED_c", "BEST_2", "BEST_2_c"]
    rows = got.orderBy(DOC).collect()
    assert [r.PREDICTED for r in rows] == ["greeting", "animal", "geometry"]
    assert all(0 < float(r.PREDICTED_c) <= 1 for r in rows)


def test_places_without_confidence_go_to_the_first_targets(spark):
    docs = spark.createDataFrame([(1,), (2,)], f"{DOC} bigint")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.0), (1, "a", 0.1)], f"{DOC} bigint, target string, confidence double")
    got = nbest.ranked_with_zeros(docs, scores, ["a", "b", "c"], 3).orderBy(DOC, "rank").collect()
    assert [(r[DOC], r.target, r["rank"]) for r in got] == [
        (1, "c", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "b", 2), (2, "c", 3),
    ]


def test_testing_command_with_hierarchy(spark):
    rows = [(f"{t[0]}->{t}", text) for t, texts in WORDS.items() for text in texts]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], f"{DOC} bigint, target string, fulltext string")
    result = commands.testing(
        df, {"fulltext": ("fulltext", "text_ngrams", 1)},
        [Classifier("fulltext"), Classifier("fulltext", "match_target", weight=0.1)], folds=3, hierarchy_delimiter="->", n_best=3,
    )
    top = {(r.fold, r.n, r.level): r.accuracy for r in result["top_n"].collect()}
    assert len(top) == 3 * 3 * 4
    assert all(top[f, 3, "exact match"] == 1.0 for f in range(3))
    assert all(top[f, n, "exact match"] <= top[f, n, "family"] <= top[f, n, "same top level"] for f in range(3) for n in (1, 2, 3))
    assert result["predictions"].count() == 9
    assert {r.target: r.support for r in result["per_target"].collect()}.keys() == {r[0] for r in rows}


def test_missing_saved_part_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="weights"):
        store.load(spark, str(tmp_path), "weights")


def test_database_tables_are_read_by_key_range(spark):
    url = "jdbc:derby:memory:shelfmark;create=true"
    rows = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(30)], "harvested_record_id int, order_in_document int, fulltext string")
    rows.write.jdbc(url, "page_texts", mode="overwrite")
    df = relational.read_table(spark, url, "page_texts", "harvested_record_id", 0, 30, 4)
    assert df.count() == 30
    assert df._jdf.queryExecution().toRdd().getNumPartitions() == 4
    pages = relational.record_pages(df.toDF("harvested_record_id", "order_in_document", "fulltext"))
    assert pages.columns == ["record_id", "page_no", "text"]


def test_neighbours_of_near_copies_with_large_norms(spark):
    rng = np.random.default_rng(9)
    for norm, gap in ((4, 1e-7), (20, 1e-7), (400, 1e-5), (10_000, 1e-6)):
        base = rng.normal(size=(20, 16))
        base *= norm / np.linalg.norm(base, axis=1)[:, None]
        rows = np.repeat(base, 6, axis=0) + gap * rng.normal(size=(120, 16))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{DOC} long, vector array<double>")
        got = neighbours.nearest_neighbours(df, df, 3, pivots=7, exclude_self=True, test_chunk=16, train_chunk=32)
        distance = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(-1))
        np.fill_diagonal(distance, np.inf)
        want = {i: np.sort(d)[:3] for i, d in enumerate(distance)}
        for r in got.collect():
            assert distance[r[DOC], r["neighbour"]] == pytest.approx(want[r[DOC]][r["rank"] - 1], rel=1e-12)


def test_settings_without_effect_are_errors():
    for spec in (Classifier("t", "kmeans"), Classifier("t", "neighbours", "tfidf"), Classifier("t", "naive_bayes", "hash")):
        with pytest.raises(ValueError):
            commands.check_specs([spec])
    for options in ({"mode": "x"}, {"balance": [("over", 1.0)]}):
        with pytest.raises(ValueError):
            commands.check_specs([Classifier("t", "log")], **options)
    commands.check_specs([Classifier("t", "log"), Classifier("t", "neighbours", "hash", "auto")])


def test_automatic_weights_of_every_fold(spark):
    """No classifier vanishes: scores are the means with the weights learned from the fold's training set."""
    df = small_corpus(spark)
    kinds = {"fulltext": ("fulltext", "text_ngrams", 1)}
    specs = [Classifier("fulltext", weight="auto"), Classifier("fulltext", "match_target", weight=0.5)]
    docs = splits.stratified_folds(df.filter("target is not null").select(DOC, "target"), 3)
    fold = {r[DOC]: r["fold"] for r in docs.collect()}
    result = commands.testing(df, kinds, specs, folds=3, auto_folds=2)
    weights = {(r["fold"], r["classifier_id"], r["target"]): r["weight"] for r in result["weights"].collect()}
    for f in range(3):
        own = commands.automatic_weights(df, docs.filter(F.col("fold") != f).select(DOC, "target"), specs, kinds, 2)
        assert {(f, 0, r["target"]): pytest.approx(r["weight"]) for r in own.collect()} == {k: w for k, w in weights.items() if k[:2] == (f, 0)}
    want = {}
    for r in commands.ensemble_scores(df, docs, 3, specs, kinds).collect():
        f, t = fold[r[DOC]], r["target"]
        total = sum(w for (g, _, u), w in weights.items() if (g, u) == (f, t))
        if (f, r["classifier_id"], t) in weights:
            want[r[DOC], t] = want.get((r[DOC], t), 0.0) + r["confidence"] * weights[f, r["classifier_id"], t] / total
    got = {(r[DOC], r["target"]): r["confidence"] for r in result["scores"].collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and got
    auto_only = commands.testing(df, kinds, specs[:1], folds=3, auto_folds=2)["scores"].collect()
    assert auto_only and {(r[DOC], r["target"]): r["confidence"] for r in auto_only} != got


@pytest.mark.parametrize(("algorithm", "vectors"), [("naive_bayes", "tfidf"), ("match_target", "count"), ("neighbours", "hash")])
def test_any_sets_agree_with_own_folds(spark, algorithm, vectors):
    """Balancing that keeps every document goes the general way and must not change a score."""
    df = small_corpus(spark).withColumn("fulltext", F.concat_ws(" ", "fulltext", "target"))
    kinds = {"fulltext": ("fulltext", "text_ngrams", 1)}
    specs = [Classifier("fulltext", algorithm, vectors)]
    scores = [
        {(r[DOC], r["target"]): r["confidence"] for r in commands.testing(df, kinds, specs, folds=3, balance=b)["scores"].collect()}
        for b in ((), [("under", 1.0)])
    ]
    assert scores[0] and scores[1] == {k: pytest.approx(v) for k, v in scores[0].items()}


def test_over_sampling_and_plain_folds_run(spark):
    df = small_corpus(spark)
    kinds = {"fulltext": ("fulltext", "text_ngrams", 1)}
    out = commands.testing(df, kinds, [Classifier("fulltext")], folds=2, split="plain", balance=[("over", 1.0)], mode="vote")
    assert out["predictions"].count() == 9
    # contiguous folds: one trains on 1 animal and 3 geometry, the other on 3 greeting and 2 animal, before balancing
    assert {r["target"]: r["n_train"] for r in out["per_target"].collect()} == {"greeting": 0, "animal": 3, "geometry": 0}


def test_hot_key_meets_an_aggregated_lookup_in_many_tasks(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    rows = spark.range(40_000).repartition(8).select(
        F.lit(0).alias("fold"), F.col("id").alias(DOC), F.when(F.col("id") % 3 > 0, F.lit("the")).otherwise(F.col("id").cast("string")).alias("term"),
        F.lit(1.0).alias("value"),
    )
    weights = rows.select("fold", "term").distinct().select("fold", "term", F.lit("x").alias("target"), F.lit(2.0).alias("weight"))
    lookup = rows.groupBy("fold", "term").agg(F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for df, total in ((lookup_join(rows, lookup, ["fold", "term"]), 40_000), (linear.margins(weights, rows), 40_000)):
            assert len(df.collect()) == total
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sparse_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        terms = np.unique(np.append(rng.integers(0, 40, rng.integers(0, 12)), rng.zipf(1.6, rng.integers(0, 6))))
        rows.append((i * (1 << 33), i % 3, [(int(t), float(v)) for t, v in zip(terms, rng.integers(1, 4, len(terms)))]))
    rows += [(7 + i, i % 3, rows[5][2]) for i in range(60)]  # copies
    df = spark.createDataFrame(rows, f"{DOC} bigint, fold int, vector array<struct<term:bigint,value:double>>")
    got = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sparse_neighbours, "TRAIN_ROWS", 50)
        patch.setattr(sparse_neighbours, "TEST_ROWS", 30)
        patch.setattr(sparse_neighbours, "FREQUENT", 100)
        patch.setattr(sparse_neighbours, "COLUMNS", 3)
        patch.setattr(sparse_neighbours, "PAIRS", 37)
        for r in sparse_neighbours.sparse_neighbours(df, df, 4, fold="fold").collect():
            got.setdefault(r[DOC], []).append((r["rank"], r["neighbour"], round(r["distance"], 9)))
    vectors = {i: (f, dict(v)) for i, f, v in rows}
    for i, (fold, v) in vectors.items():
        square = lambda w: sum((v.get(t, 0.0) - w.get(t, 0.0)) ** 2 for t in {*v, *w})
        want = sorted((round(square(w), 12), j) for j, (f, w) in vectors.items() if f != fold)[:4]
        assert sorted(got[i]) == [(n + 1, j, round(d**0.5, 9)) for n, (d, j) in enumerate(want)]


@pytest.mark.parametrize("fit", [linear.fit, linear.fit_stochastic])
def test_folds_share_their_documents(spark, monkeypatch, fit):
    """Terms are given and packed once for all folds, not once per fold; weights and margins are those of terms per fold."""
    monkeypatch.setattr(linear, "CHUNK_CELLS", 30)
    rnd = random.Random(8)
    rows = [{f"t{rnd.randrange(5)}": 1.0 + rnd.random() for _ in range(rnd.randrange(4))} for _ in range(24)]
    docs = spark.createDataFrame([(f, i, "abc"[i % 3]) for f in range(4) for i in range(24)], f"fold int, {DOC} bigint, target string")
    terms = spark.createDataFrame([(i, t, v) for i, r in enumerate(rows) for t, v in r.items()], f"{DOC} bigint, term string, value double")
    losses = dict(enumerate(("log", "hinge", "huber", "perceptron")))
    per_fold = terms.join(docs.select("fold", DOC), DOC)
    key = lambda r: (r["fold"], r["term"], r["target"])
    once, each = (fit(t, docs, losses, 1e-3, 2) for t in (terms, per_fold))
    got, want = ({key(r): r["weight"] for r in df.collect()} for df in (once, each))
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} and len(got) == 4 * 3 * (len({t for r in rows for t in r}) + 1)
    packed = linear._packed(terms, docs.withColumn("own", F.lit(-1)), 3, DOC, minibatches=fit is linear.fit_stochastic)
    assert packed.chunks.agg(F.sum(F.size("docs"))).first()[0] == 24
    key = lambda r: (r["fold"], r[DOC], r["target"])
    got = {key(r): r["margin"] for r in linear.packed_margins(once, terms, docs).collect()}
    want = {key(r): r["margin"] for r in linear.margins(once, linear.with_bias(per_fold, docs)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} and len(got) == 4 * 24 * 3


def test_terms_that_bring_their_class_are_not_joined_with_documents(spark):
    """The same sums; terms with a class are aggregated where they are."""
    docs = spark.createDataFrame([(i % 2, i, "ab"[i % 3 > 0]) for i in range(9)], f"fold int, {DOC} bigint, target string")
    terms = docs.select("fold", DOC, F.explode(F.array(F.lit("x"), F.col("target"), F.col(DOC).cast("string"))).alias("term"), F.lit(1.5).alias("value"))
    brought = terms.join(docs, ["fold", DOC]).localCheckpoint()
    got, want = (bayes.class_sums(t, docs)[0] for t in (brought, terms))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    model = bayes.fit(*bayes.cross_fold_sums(brought, docs, 2))
    scores = {tuple(r)[:3]: r["confidence"] for r in bayes.score(model, brought, docs).collect()}
    assert scores == {tuple(r)[:3]: pytest.approx(r["confidence"]) for r in bayes.score(model, terms, docs).collect()} and len(scores) == 18


def test_embeddings_move_no_row_per_term(spark, monkeypatch):
    """Blocks of terms and groups of columns give what one block gives; terms of one document are not looked up."""
    rng = np.random.default_rng(12)
    x = rng.random((30, 25)) * (rng.random((30, 25)) < 0.3)
    x[:, 20:] = 0.0
    x[range(5), range(20, 25)] = 2.0  # terms of one document
    x[5] = x[6] = 0.0
    docs = spark.createDataFrame([(i,) for i in range(30)], f"{DOC} bigint")
    terms = spark.createDataFrame([(i, f"t{j}", float(v)) for (i, j), v in np.ndenumerate(x) if v], f"{DOC} bigint, term string, value double")
    at = lambda size: np.array([r["vector"] for r in sorted(embeddings.document_embeddings(terms, docs, size).collect(), key=lambda r: r[DOC])])
    whole = at(6)
    monkeypatch.setattr(embeddings, "BLOCK_CELLS", 40)
    monkeypatch.setattr(embeddings, "MATRIX_CELLS", 60)
    blocks, wide = embeddings.shape(28, 140, 20, 6)
    assert blocks > 1 and wide < 6
    assert np.allclose(at(6), whole, atol=1e-8) and np.allclose(at(30) @ at(30).T, x @ x.T, atol=1e-8)
    places, cells, n = embeddings._places(embeddings.pack(terms), DOC)
    assert n == ((x > 0).sum(0) > 1).sum() and cells == (x[:, (x > 0).sum(0) > 1] > 0).sum()
    assert places.agg(F.sum("lone")).first()[0] == pytest.approx((x[:, (x > 0).sum(0) == 1] ** 2).sum())
