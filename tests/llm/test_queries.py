"""The registered queries at the smallest scale, against their SQL where there is one, and the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from shelfmark.llm import secrets
from shelfmark.llm.common import read
from shelfmark.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, compare

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES))
def test_against_sql(spark, name):
    rows, problem = compare(spark, name, SF, QUERIES, ORACLES)
    assert rows and problem == ""


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    benchmark = {r["item_id"]: r["text"] for r in read(spark, SF, "benchmark").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        after = after.cache()
        left = {r["doc_id"]: r["text"] for r in after.collect()}
        assert set(left) <= ids, name
        if name == "decontamination":
            joined = {d: " ".join(t.lower().split()) for d, t in left.items()}
            assert not any(" ".join(b.lower().split()) in t for b in benchmark.values() for t in joined.values())
        if name == "secret_scan":
            assert set(left) == ids
            assert any("[secret]" in t for t in left.values()) == any(secrets.find(r["text"]) for r in docs.collect())
            assert not any(secrets.find(t) for t in left.values())
        docs, ids = after, set(left)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in mixed} == ids
    assert {r["doc_id"] for r in QUERIES["pipeline"](spark, SF).collect()} == ids
