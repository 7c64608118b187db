import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tastegrid.llm.oracle import ORACLE
from tastegrid.llm.queries import QUERIES
from tastegrid.llm.tables import table
from tests.oracle_compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_the_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""


def test_stages_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(seen[r["doc_id"]].startswith(r["text"].rstrip()) for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
        counts.append(len(rows))
    assert counts[0] >= counts[1] >= counts[2] > 0
    left = docs.selectExpr("lower(text)").distinct().count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count() and left > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2])
def test_stages_on_empty_and_null_rows(spark, rows):
    schema = table(spark, SF, "documents").schema
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
