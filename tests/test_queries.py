"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from cairn.plans import catalogue
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLES[name], SMALL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
