"""Every registered query: same rows as its SQL, and a plan that scales."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402

from workload import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
PYTHON = {"predict", "generate_stage_skip", "generate_seq2seq", "translate_fallback"}


@pytest.fixture(scope="module")
def duck():
    return check.connect(DATA)


def test_every_query_has_its_sql():
    assert set(contract.oracle_sql()) >= set(QUERIES)
    assert set(contract.queries()) >= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, DATA)
    got = frame.toPandas()
    assert check.difference(got, duck.execute(contract.oracle_sql()[name]).df()) is None
    assert len(got) > 0
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InPandas" not in plan
