from shelfmark.functions import hierarchy as h
from shelfmark.functions import items as it
from shelfmark.functions import text as tx
from shelfmark.operators import ensemble, features
from shelfmark.operators.skew import DOC


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_split_items_edge_rows(spark):
    cases = {
        None: [], "": [], " ": [""], "a": ["a"], "a$|$": ["a", ""], "a $|$ a": ["a", "a"],
        "\t a \t$|$b": ["a", "b"], "$": ["$"],
    }
    for value, want in cases.items():
        assert one(spark, it.split_items("v"), value) == want, value
    assert one(spark, it.split_items("v", None), " a ") == [" a "]


def test_select_items(spark):
    value = ["a", "b", "c", "d", "e"]
    for selector, want in [(0, ["a"]), (9, []), (slice(1, 3), ["b", "c"]), (slice(2, None), ["c", "d", "e"]),
                           (slice(0, None, 2), ["a", "c", "e"]), (slice(3, 1), [])]:
        assert one(spark, it.select_items("v", selector), value, "array<string>") == want, selector


def test_match_only_at_start(spark):
    assert one(spark, it.match_items("v", "b|c"), ["bc", "ab", "c"], "array<string>") == ["bc", "c"]


def test_concat_of_nothing_is_null(spark):
    assert one(spark, it.concat_fields("v", "v"), [], "array<string>") is None


def test_grams_and_parts(spark):
    assert one(spark, tx.text_ngrams(tx.words("v"), 2), "a b c") == ["a_b", "b_c"]
    assert one(spark, tx.text_ngrams(tx.words("v"), 5), "a b") == ["a_b"]
    assert one(spark, tx.item_ngrams("v", 2), ["a b c", "d"], "array<string>") == ["a b", "b c", "d"]
    parts = one(spark, tx.word_parts(tx.words("v"), 2), "a b c")
    assert [(p.part_no, p.words, p.is_last) for p in parts] == [(0, ["a", "b"], False), (1, ["c"], True)]
    assert [(p.words, p.is_last) for p in one(spark, tx.word_parts(tx.words("v"), 2), "")] == [([], True)]


def test_count_terms(spark):
    counted = one(spark, tx.count_terms("v"), ["b", "a", "b", ""], "array<string>")
    assert [tuple(e) for e in counted] == [("", 1.0), ("a", 1.0), ("b", 2.0)]
    assert not one(spark, tx.count_terms("v"), [], "array<string>")


def test_text(spark):
    assert one(spark, tx.separate_signs("v"), "Ahoj, co (nového)?") == ["Ahoj", ",", "co", "(", "nového", ")", "?"]
    assert one(spark, tx.transliterate("v"), "Žluťoučký kůň, Straße, œuvre, Łódź") == "Zlutoucky kun, Strasse, oeuvre, Lodz"
    assert one(spark, tx.join_hyphenated("v"), "th-\r\ne end\nof") == "the end of"
    assert tx.part_of_speech([1, "2", 10, "Z"]) == ["N", "A", "I", "Z"]
    # a stop word with a sign inside is removed early, before it is split
    assert one(spark, tx.clean_text("v", separate=True, stop_words=["a-b"]), "x a-b  y-z") == "x y - z"
    assert one(spark, tx.clean_text("v", case="upper"), "") == ""


def test_hierarchy(spark):
    df = spark.createDataFrame([("a->b", "a->b->c"), ("a", "a->b->c"), ("a->x", "a->b"), ("b", "a")], "p string, q string")
    got = df.select(h.direct_family("p", "q"), h.same_family("p", "q"), h.same_top_level("p", "q")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]


def test_match_target_vector(spark):
    names = features.target_words(spark.createDataFrame([("A C D",), ("B G F",)], "target string"))
    counts = spark.createDataFrame([(0, "a", 4.0), (0, "B", 2.0), (0, "C", 1.0)], f"{DOC} bigint, term string, value double")
    got = {r.target: r.value for r in features.target_matches(counts, names).collect()}
    assert got == {"A C D": 5.0, "B G F": 2.0}


def test_confusion_shares(spark):
    rows = [("A", "A")] * 7 + [("A", "B")] + [("B", "A")] * 3 + [("B", "B")] * 9 + [("C", "C")] * 10
    got = ensemble.confusion_shares(spark.createDataFrame(rows, "target string, predicted string")).collect()
    assert {(r.predicted, r.meant): round(r.share, 6) for r in got} == {
        ("A", "A"): 0.7, ("A", "B"): 0.3, ("B", "A"): 0.1, ("B", "B"): 0.9, ("C", "C"): 1.0,
    }


def test_weighted_vote_and_unclassified(spark):
    docs = spark.createDataFrame([(1,), (2,)], f"{DOC} bigint")
    votes = spark.createDataFrame([(1, 0, "A"), (1, 1, "A"), (1, 2, "B")], f"{DOC} bigint, classifier_id int, predicted string")
    weights = spark.createDataFrame([(0, "A", 0.3), (1, "A", 0.4), (2, "B", 0.6)], "classifier_id int, target string, weight double")
    got = {r[DOC]: r.predicted for r in ensemble.weighted_vote(docs, votes, weights).collect()}
    assert got == {1: "A", 2: ""}


def test_skip_empty_leaves_one_unclassified(spark):
    df = spark.createDataFrame([(0, ["a"], ["x"]), (1, ["a"], []), (2, None, ["x"]), (3, [], None)],
                               f"{DOC} bigint, f array<string>, g array<string>")
    kinds = {"f": ("f", "whole_item", 1), "g": ("g", "whole_item", 1)}
    got = sorted(tuple(r) for r in features.analyse_kinds(df, kinds).select(DOC, "kind").collect())
    assert got == [(0, "f"), (0, "g"), (1, "f"), (2, "g")]
