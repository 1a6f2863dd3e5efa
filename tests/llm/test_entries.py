"""The registered text queries and the pipeline."""

import importlib.util

import pytest
from conftest import canonical

from locusframe.llm.entries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    df, found = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), found.columns)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "source", "ids", "decoded"] and 0 < rows.count() < 2 * n
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
