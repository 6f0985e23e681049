"""Registered queries against their SQL, and the pipeline against its stages."""

import pytest

import corpus_pipeline
from cohortlens.llm import catalog, decontaminate, neardup, quality
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_sql(spark, con, name):
    assert compare(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name]) == ""


def test_pipeline_decisions(spark):
    """Each document goes for a reason that can be checked by itself, and every other one stays."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.op3_quality_lines(spark, SF).filter("kept").collect()}
    kept = table.filter(table.doc_id.isin(list(good)))
    groups = {r.doc_id: r.component_id for r in neardup.cluster(kept, "doc_id", "text", width=5).collect()}
    leaked = {r.doc_id for r in decontaminate.template_leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(out) == {k for k in good if groups[k] == k and k not in leaked}
    assert all(r.round_trip and r.lang == docs[k].lang and len(r.ids) == 4 * r.n_tokens for k, r in out.items())


def test_stages_take_empty_tables_and_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 30, None, None, None)] * 2 + [(3, " ".join(f"word{i}" for i in range(40)), "en", "s", 1)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns and got.count() <= len(data)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(data)
