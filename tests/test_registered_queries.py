"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tests.compare import connect, run_pair

from __spark_entry__ import entry  # isort: skip
from labspark.plans.oracle import oracle  # isort: skip
from labspark.plans.queries import QUERIES  # isort: skip

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = run_pair(spark, con, name, SF_DIR, QUERIES[name], oracle()[name])
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle())


def test_entry(spark):
    assert entry(spark).count() > 0
