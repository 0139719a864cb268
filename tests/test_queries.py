"""A sample of the registered queries against their SQL on the smallest data; ``python -m tests.oracle`` runs them all."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare

SAMPLE = [
    "a03_aligned_scan", "b09_match_items", "c01_record_merge", "d10_target_scores", "d13_top_n_accuracy", "d14_confusion_matrix",
    "e01_n_best", "e09_stratified_shuffle", "g10_clean_text", "h03_hash_vectors", "i07_kmeans_scores", "i08_probability_calibration",
    "i11_ensemble_by_confidence", "j10_metadata_export",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    rows, problem = compare(spark, name, f"{DATA}/sf0.001", entry.queries(), entry.oracle_sql())
    assert problem == "" and rows > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
