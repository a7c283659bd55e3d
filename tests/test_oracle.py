"""Registered queries against their SQL answers.

Every query at sf0.001; TERMLAB_ORACLE_SF names another scale factor.
"""

from __future__ import annotations

import os

import pytest
from compare import connect, difference, duck_rows, spark_rows

import __spark_entry__ as entry
from termlab.plans import oracle, workload

SF = f"/root/testdata/{os.environ.get('TERMLAB_ORACLE_SF', 'sf0.001')}"
NAMES = sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_answer():
    assert set(workload.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["curve_id", "tradingDay"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    left = spark_rows(entry.queries()[name](spark, SF))
    assert difference(left, duck_rows(duck, entry.oracle_sql()[name])) is None
