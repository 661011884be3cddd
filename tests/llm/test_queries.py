from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from corpusmill.llm import queries
from corpusmill.llm.common import table, written
from tests.parity import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert not difference(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = written(stage(spark, docs, SF))
        assert left.columns == columns and left.count() <= docs.count(), name
        assert left.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        docs = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    good = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    assert good.join(docs, "doc_id").count() > 0.5 * good.count()
