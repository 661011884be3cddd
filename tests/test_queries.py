"""Every query against its SQL, and those without SQL for rows and a stable schema."""

from __future__ import annotations

import pytest

import __spark_entry__
from corpusmill import catalogue
from tests.parity import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    assert not difference(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lang", "reason_code", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
