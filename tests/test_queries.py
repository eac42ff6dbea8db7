"""Every registered query of the core against its SQL counterpart."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import oracle
from lustra.workload.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    return oracle.connect(SF_DIR)


def test_each_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    assert oracle.differences(entry.queries()[name](spark, SF_DIR), database, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
