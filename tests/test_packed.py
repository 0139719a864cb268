"""Packed term lists against the long forms."""

import numpy as np
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import features as ft
from shelfmark.operators import packed
from shelfmark.operators.embeddings import sign_matrix, signs
from shelfmark.operators.skew import DOC

TEXTS = [(1, "a b a"), (2, " b c "), (3, ""), (4, None), (5, "c c c d")]


def analysed(spark):
    df = spark.createDataFrame(TEXTS, f"{DOC} bigint, fulltext string")
    return ft.analyse_kinds(df, {"k": ("fulltext", "text_ngrams", 1)})


def cells(df):
    return {(r[DOC], r["kind"], r["term"]): round(r["value"], 12) for r in df.collect()}


def test_words_have_no_empty_ends(spark):
    rows = spark.createDataFrame([(t,) for t in (" a  b ", "", "   ", "a", None)], "t string").select(tx.words("t").alias("w")).collect()
    assert [r["w"] for r in rows] == [["a", "b"], [], [], ["a"], None]


def test_packed_tfidf_agrees_and_needs_no_window(spark):
    terms = analysed(spark)
    counts = ft.count_vectors(terms)
    long = ft.tfidf(counts, ft.inverse_frequencies(counts, ft.documents_per_kind(terms)))
    rows = packed.unpacked(ft.packed_tfidf(terms), (DOC, "kind"))
    assert cells(rows) == cells(long) and len(cells(rows)) == 6
    assert "Window" not in rows._jdf.queryExecution().toString()


def test_chunks_of_few_cells_give_the_same(spark, monkeypatch):
    whole = cells(packed.unpacked(ft.packed_tfidf(analysed(spark)), (DOC, "kind")))
    monkeypatch.setattr(packed, "CHUNK_CELLS", 2)
    assert cells(packed.unpacked(ft.packed_tfidf(analysed(spark)), (DOC, "kind"))) == whole


def test_sign_matrix_is_made_of_signs():
    terms = ["a", "é", "long term"]
    assert (sign_matrix(terms, 0, 70, 3) == np.stack([signs(t, 70, 3) for t in terms])).all()
    assert (sign_matrix(terms, 32, 70, 3) == np.stack([signs(t, 70, 3)[32:] for t in terms])).all()


def test_lexicon_lookups_keep_order_columns_and_second_analyses(spark):
    from shelfmark.operators import lexicon as lx

    df = spark.createDataFrame([(1, ["x", "y", "x"], "m"), (2, [], "n"), (3, None, "o")], f"{DOC} bigint, tokens array<string>, more string")
    lexicon = spark.createDataFrame([("x", "X1", "N"), ("y", "Y1", None), ("y", "Y2", "V")], "form string, lemma string, tag string")
    found = sorted(tuple(r) for r in lx.analyse(df, "tokens", lexicon).collect())
    assert found == [(1, 0, "x", "X1", "N"), (1, 1, "y", "Y1", "X"), (1, 1, "y", "Y2", "V"), (1, 2, "x", "X1", "N")]
    kept = lx.remove_listed(df, "tokens", lexicon.filter("form = 'x'"))
    assert {r[DOC]: (r["tokens"], r["more"]) for r in kept.collect()} == {1: (["y"], "m"), 2: ([], "n"), 3: ([], "o")}
    plan = kept._jdf.queryExecution().toString()
    assert "collect_list" not in plan  # no row per document and form is made


def test_neighbours_of_many_chunks_are_exact_and_shuffled_once(spark, monkeypatch):
    from shelfmark.operators import sparse_neighbours as sn

    monkeypatch.setattr(sn, "TRAIN_ROWS", 7)
    monkeypatch.setattr(sn, "TEST_ROWS", 5)
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 3, (60, 6)).astype(float)
    rows = [(i, i % 3, [(j, v) for j, v in enumerate(x) if v]) for i, x in enumerate(dense.tolist())]
    df = spark.createDataFrame(rows, f"{DOC} bigint, fold int, vector array<struct<term: bigint, value: double>>")
    result = sn.sparse_neighbours(df, df, 3, fold="fold")
    got = {(r[DOC], r["rank"]): r["neighbour"] for r in result.collect()}
    for i in range(60):
        square = ((dense - dense[i]) ** 2).sum(1)
        order = sorted((d, j) for j, d in enumerate(square) if j % 3 != i % 3)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in order]
    plan = result._jdf.queryExecution().toString()
    assert "Join Cross" in plan and "RepartitionByExpression" not in plan  # no copy of a chunk per pair


def test_packed_bayes_agrees_with_the_long_form(spark, monkeypatch):
    from shelfmark.operators import bayes
    from shelfmark.plans import commands

    texts = [(i, " ".join("abcdefg"[(i * j) % 7] for j in range(1, 5 + i % 3)) if i % 5 else " " * (i % 2)) for i in range(24)]
    df = spark.createDataFrame(texts, f"{DOC} bigint, fulltext string")
    learn = spark.createDataFrame([(f, i, "xyz"[i % 3]) for f in (0, 1) for i in range(24) if (i + f) % 4] + [(0, 1, "y")], f"fold int, {DOC} bigint, target string")
    asked = spark.createDataFrame([(f, i) for f in (0, 1) for i in range(0, 24, 2 + f)], f"fold int, {DOC} bigint")
    kinds = {"k": ("fulltext", "text_ngrams", 1)}
    terms = ft.analyse_kinds(df, kinds)
    assert {r[0] for r in ft.usable(df, kinds["k"]).collect()} == {r[0] for r in terms.select(DOC).collect()}
    counts = ft.count_vectors(terms).drop("kind")
    mine, theirs = (d.join(terms.select(DOC), DOC, "left_semi") for d in (learn, asked))
    rows = [counts.join(d.select("fold", DOC).distinct(), DOC) for d in (mine, theirs)]
    long = bayes.score(bayes.fit(*bayes.class_sums(rows[0], mine)), rows[1], theirs)
    flat = lambda d: {(r["fold"], r[DOC], r["target"]): round(r["confidence"], 9) for r in d.collect()}
    want = flat(long)
    assert len(want) > 30
    for cells, expanded in ((1 << 19, 1 << 22), (6, 5)):
        monkeypatch.setattr(packed, "CHUNK_CELLS", cells)
        monkeypatch.setattr(bayes, "EXPANDED", expanded)
        got = commands.set_scores(df, learn, learn, asked, 2, commands.Classifier("k"), kinds)
        assert flat(got) == want
    plan = got._jdf.queryExecution().toString()
    assert "CoGroups" in plan and "inline(concat" not in plan  # no row per document, fold, term and class is made


def test_sums_of_dense_and_of_sparse_keys():
    from shelfmark.operators.bayes import _summed

    keys, values = np.array([5, 2, 5, 9]), np.array([1.0, 2.0, -1.0, 4.0])
    for many in (10, 1 << 40):
        found, sums = _summed(keys, values, many)
        assert found.tolist() == [2, 5, 9] and sums.tolist() == [2.0, 0.0, 4.0]


def test_text_folder_keeps_every_page(spark):
    """Pages of the same name stay apart, an empty one is skipped, and there is no directory per page."""
    from urllib.parse import urlparse

    from shelfmark.session import scratch_path
    from shelfmark.sources import files, sinks

    folder = scratch_path(spark, "texts")
    df = spark.createDataFrame([("1_0", "a \n b"), ("1_0", "c"), ("1_1", ""), ("1_2", None), ("2_0", "é\n")], "page string, text string").repartition(2)
    assert sinks.write_text_folder(df, folder, "page", "text") == 3
    rows = sorted(map(tuple, files.scan_text_folder(spark, folder, r"~([^/]*)\.txt$").collect()))
    assert rows == [("1_0", "a b"), ("1_0", "c"), ("2_0", "é ")]
    assert sum(p.is_dir() for p in __import__("pathlib").Path(urlparse(folder).path).iterdir()) <= 2


def test_dense_neighbours_in_blocks_are_exact_and_copies_few(spark, monkeypatch):
    from shelfmark.operators import neighbours as nb

    assert min(nb.ROWS_PER_PIVOT, nb.TEST_CHUNK) >= nb.TRAIN_CHUNK >= 1 << 14 and nb.TEST_BLOCK * nb.TRAIN_CHUNK <= 1 << 23
    monkeypatch.setattr(nb, "TEST_BLOCK", 7)
    x = np.random.default_rng(3).integers(0, 3, (50, 4)).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"{DOC} bigint, vector array<double>")
    got = {(r[DOC], r["rank"]): r["neighbour"] for r in nb.nearest_neighbours(df, df, 3, exclude_self=True).collect()}
    for i in range(50):
        order = sorted((d, j) for j, d in enumerate(((x - x[i]) ** 2).sum(1)) if j != i)[:3]
        assert [got[i, r] for r in (1, 2, 3)] == [j for _, j in order]


def test_both_hash_forms_in_one_pass_without_a_shuffle(spark):
    terms = analysed(spark)
    counts = ft.count_vectors(terms)
    for bucket in (ft.portable_bucket, ft.term_bucket):
        sign = 1.0 - 2.0 * bucket(F.concat(F.lit("sign:"), "term"), 2)
        want = {}
        for signed, value in ((False, F.col("value")), (True, sign * F.col("value"))):
            sums = counts.groupBy(DOC, bucket(F.col("term"), 3).alias("term")).agg(F.sum(value).alias("value"))
            want |= {(r[DOC], signed, r["term"]): round(r["value"], 12) for r in ft.normalise(sums.filter("value <> 0"), (DOC,)).collect()}
        rows = ft.hash_forms(terms, 3, bucket=bucket, keys=(DOC,))
        assert {(r[DOC], r["signed"], r["term"]): round(r["value"], 12) for r in rows.collect()} == want and len(want) > 6
        one = ft.hash_vectors(terms, 3, False, bucket, (DOC,))
        assert {(r[DOC], True, r["term"]): round(r["value"], 12) for r in one.collect()} == {k: v for k, v in want.items() if k[1]}
        assert not any(x in one._jdf.queryExecution().toString() for x in ("Exchange", "Window"))


def test_distinct_numbers_of_dense_and_of_sparse_ranges():
    for many in (10, 1 << 40):
        found, place = packed._distinct(np.array([5, 2, 5, 9]), many)
        assert found.tolist() == [2, 5, 9] and place.tolist() == [1, 0, 1, 2]


def test_extracted_features_are_analysed_once(spark):
    from shelfmark.plans import commands

    df = spark.createDataFrame([*TEXTS, (6, "b")], f"{DOC} bigint, fulltext string")
    parts = commands.extract_features(df, {"k": ("fulltext", "text_ngrams", 1)})
    assert {(r[DOC], r["term"]): r["value"] for r in parts["counts"].collect()} == {
        (1, "a"): 2.0, (1, "b"): 1.0, (2, "b"): 1.0, (2, "c"): 1.0, (5, "c"): 3.0, (5, "d"): 1.0, (6, "b"): 1.0}
    assert [tuple(r) for r in parts["documents"].collect()] == [("k", 4)] and [tuple(r) for r in parts["sizes"].collect()] == [("k", 4)]
    assert not any("MapInArrow" in p._jdf.queryExecution().toString() for p in parts.values())  # all read what is stored


def test_words_are_not_shuffled_to_meet_few_target_names(spark):
    rows = [(1, ["a", "A", "->", "x"]), (2, ["b", "x"]), (3, []), (4, None), (5, ["X"])]
    df = spark.createDataFrame(rows, f"{DOC} bigint, terms array<string>").withColumn("kind", F.lit("k"))
    names = ft.target_words(spark.createDataFrame([("A x",), ("a b",), ("q",)], "target string"))
    hits = ft.target_matches(ft.count_vectors(df), names)
    assert {(r[DOC], r["target"]): r["value"] for r in hits.collect()} == {
        (1, "A x"): 3.0, (1, "a b"): 2.0, (2, "A x"): 1.0, (2, "a b"): 1.0, (5, "A x"): 1.0}
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "upper" in plan
    assert hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_a_task_sorts_about_one_chunk(spark, monkeypatch):
    """The partitions follow the chunks and the lines, not the session's setting."""
    from shelfmark.checks import fixtures as fx
    from tests.oracle import DATA

    rows = [(i, "a b") for i in range(40)]
    terms = ft.analyse_kinds(spark.createDataFrame(rows, f"{DOC} bigint, fulltext string").repartition(5), {"k": ("fulltext", "text_ngrams", 1)})
    assert ft.packed_tfidf(terms).rdd.getNumPartitions() == 5  # a chunk per task that counted
    few = fx.records(spark, f"{DATA}/sf0.001")
    monkeypatch.setattr(fx, "LINES_PER_TASK", 100)
    many = fx.records(spark, f"{DATA}/sf0.001")
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    lines = spark.read.parquet(f"{DATA}/sf0.001/lineitem.parquet").count()
    assert f", {lines // 100 + 1}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()


def test_rows_pass_by_what_a_task_holds(spark):
    """Every part of one side meets every part of the other; a row is sent to Python once per part it meets."""
    import pyarrow as pa

    from shelfmark.operators.products import stream

    rows = spark.range(0, 10, 1, 3).withColumnRenamed("id", "a")
    held = spark.range(0, 7).select(F.col("id").alias("b"), (F.col("id") % 2).cast("int").alias("part")).repartitionById(2, "part")

    def run(kept, passing):
        found = [r["a"] for r in passing]
        yield pa.RecordBatch.from_arrays([pa.array([kept[0]["part"]]), pa.array([sorted(k["b"] for k in kept)]), pa.array([found])], names=["part", "b", "a"])

    result = stream(rows, held, run, "part bigint, b array<bigint>, a array<bigint>")
    got = sorted(map(tuple, result.collect()))
    assert got == [(p, [b for b in range(7) if b % 2 == p], a) for p in (0, 1) for a in ([0, 1, 2], [3, 4, 5], [6, 7, 8, 9])]
    assert stream(rows.filter("a < 0"), held, run, result.schema).collect() == []
    plan = result._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1  # only what is held is dealt out


def test_a_power_step_moves_the_vectors_only_twice(spark, monkeypatch):
    """However many blocks of terms there are, neither cells nor sums per block are shuffled."""
    from shelfmark.operators import embeddings as em

    monkeypatch.setattr(em, "RUN", 8)
    monkeypatch.setattr(em, "DIAGONAL", 8)
    rng = np.random.default_rng(5)
    x = rng.random((30, 12)) * (rng.random((30, 12)) < 0.5) + np.eye(30, 12)
    terms = spark.createDataFrame([(i, f"t{j}", float(v)) for (i, j), v in np.ndenumerate(x) if v], f"{DOC} bigint, term string, value double")
    packed_rows, docs = em._numbered(em.pack(terms).repartition(3))
    places, _, _ = em._places(packed_rows, "no")
    rows = em._rows(em.project(packed_rows.select("no", "terms", "values"), 5), 5)
    at = lambda df: np.concatenate([np.frombuffer(r["matrix"]).reshape(-1, 5)[np.argsort(np.frombuffer(r["docs"], np.int32))] for r in sorted(df.collect(), key=lambda r: r["run"])])
    order = {r["no"]: r[DOC] for r in packed_rows.select("no", DOC).collect()}
    own, basis, found = x[[order[i] for i in range(docs)]], rng.random((5, 5)), []
    signs_ = np.stack([signs(f"t{j}", 5) for j in range(12)])
    for n in (1, 7):
        parts = em._power(em._blocks(places, n), rows, basis, 2, docs, 5)
        found.append(at(em._assembled(parts, 2)))
        assert parts.count() == 3 * -(-docs // 8) and "CoGroup" not in parts._jdf.queryExecution().sparkPlan().toString()
        assert np.allclose(found[-1], own @ (own.T @ (own @ signs_ @ basis)))


def test_pulls_do_not_grow_with_the_chunks(spark, monkeypatch):
    """A task sends one matrix of pulls per block of terms and columns for all of its chunks; a term without a weight counts nothing."""
    from shelfmark.operators import linear

    monkeypatch.setattr(linear, "CHUNK_CELLS", 1)
    monkeypatch.setattr(linear, "MAX_TASKS", 2)
    seen, plain = [], linear.stream
    monkeypatch.setattr(linear, "stream", lambda *a: seen.append(plain(*a)) or seen[-1])
    docs = spark.createDataFrame([(f, i, "ab"[i % 2]) for f in (0, 1) for i in range(24)], f"fold int, {DOC} bigint, target string")
    terms = spark.createDataFrame([(i, f"t{(i + j) % 5}", 0.5) for i in range(24) for j in range(i % 3)], f"{DOC} bigint, term string, value double")
    for fit in (linear.fit, linear.fit_stochastic):
        weights = fit(terms, docs, "log", 1e-3, 2)
        assert weights.count() == 2 * 6 * 2
        assert len(seen) == 2 and all(1 <= p.count() <= 2 for p in seen)
        seen.clear()
    more = terms.unionByName(spark.createDataFrame([(0, "unknown", 9.0), (3, "unknown", 9.0)], terms.schema))
    margins = lambda t: {(r["fold"], r[DOC], r["target"]): round(r["margin"], 9) for r in linear.packed_margins(weights, t, docs).collect()}
    assert margins(more) == margins(terms) and len(margins(terms)) == 2 * 24 * 2


def test_tfidf_of_all_folds_stays_packed(spark, monkeypatch):
    """Cross-validated naive Bayes on tf-idf as from long rows, without a row per document, term and fold."""
    from shelfmark.operators import bayes
    from shelfmark.plans import commands

    texts = [(i, " ".join("abcdefg"[(i * j) % 7] for j in range(1, 5 + i % 3)) if i % 5 else " " * (i % 2)) for i in range(24)]
    df = spark.createDataFrame([*texts, (99, "q q")], f"{DOC} bigint, fulltext string")
    docs = spark.createDataFrame([(i, "xyz"[i % 4 % 3], i % 3) for i in (*range(24), 99)], f"{DOC} bigint, target string, fold int")
    kinds = {"k": ("fulltext", "text_ngrams", 1)}
    counts = ft.count_vectors(ft.analyse_kinds(df, kinds)).drop("kind")
    mine = docs.join(counts.select(DOC).distinct(), DOC, "left_semi")
    want = {}
    for fold in range(3):
        learn, asked = mine.filter(F.col("fold") != fold).withColumn("fold", F.lit(fold)), mine.filter(F.col("fold") == fold)
        rows, tests = (counts.join(d.select("fold", DOC), DOC) for d in (learn, asked))
        idf = ft.inverse_frequencies(rows, learn.groupBy("fold").agg(F.count(F.lit(1)).alias("n_docs")), ("fold",))
        rows, tests = (ft.tfidf(r, idf, ("fold",), (DOC, "fold")) for r in (rows, tests))
        want |= {(r[DOC], r["target"]): r["confidence"] for r in bayes.score(bayes.fit(*bayes.class_sums(rows, learn)), tests, asked).collect()}
    for name in ("tfidf", "normalise", "count_vectors"):
        monkeypatch.setattr(ft, name, None)
    got = commands.cross_fold_scores(df, docs, 3, commands.Classifier("k", vectors="tfidf"), kinds)
    got = {(r[DOC], r["target"]): r["confidence"] for r in got.collect()}
    assert len(got) > 40 and {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_a_text_is_not_stored_beside_its_tokens(spark, monkeypatch):
    """Only its tokens meet the lexicon; empty, blank and missing texts stay what they were."""
    from shelfmark.operators import lexicon as lx

    seen, plain = [], lx.chunked
    monkeypatch.setattr(lx, "chunked", lambda df, *a, **k: seen.append(df.columns) or plain(df, *a, **k))
    df = spark.createDataFrame([(1, "x y, x", "m"), (2, "", "n"), (3, " ", "o"), (4, None, "p")], f"{DOC} bigint, fulltext string, more string")
    lexicon = spark.createDataFrame([("x", "X1", "N")], "form string, lemma string, tag string")
    rows = lx.preprocess(df, lexicon=lexicon, lemmas=True)
    assert rows.columns == df.columns and seen == [[DOC, "more", "_tokens", "_empty"]]
    assert {r[DOC]: (r["fulltext"], r["more"]) for r in rows.collect()} == {1: ("X1 y , X1", "m"), 2: ("", "n"), 3: ("", "o"), 4: ("", "p")}


def test_lines_are_numbered_without_a_shuffle_of_them(spark):
    from shelfmark.session import scratch_path
    from shelfmark.sources import files

    path = scratch_path(spark, "lines.txt")
    spark.range(0, 40, 1, 4).select(F.col("id").cast("string")).write.text(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = files.number_lines(files.scan_texts(spark, path))
        assert sorted(r[DOC] for r in rows.collect()) == list(range(40))
        assert "BroadcastHashJoin" in rows._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
