import os

import pytest

from tests.compare import differences, duck

import corpus_pipeline
from listwright.llm import queries
from listwright.llm.base import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NATIVE = ["op1_secret_scan", "op3_benchmark_decontamination", "op4_quality_rules", "op7_url_filter", "op13_source_mixing"]


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, connection, name):
    frame = queries.QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in NATIVE:
        assert "Python" not in plan and "Pandas" not in plan
    if name in queries.CHECKS:
        assert differences(frame, connection, queries.CHECKS[name]) is None
    else:
        assert frame.count() > 0


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = table(spark, SF, "documents")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        left = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids, name


def test_pipeline_is_its_stages_in_turn(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near copies", "decontamination", "encoding"]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
