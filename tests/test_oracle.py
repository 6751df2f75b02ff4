"""Every registered query against its SQL on an independent engine."""

import os

import oracle_check
import pytest

from newspulse.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Too few articles for an event in the smallest tables.
NEEDS_MORE_ROWS = {"incremental_refresh": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    sf_dir = NEEDS_MORE_ROWS.get(name, SF_DIR)
    con = oracle_check.connect(sf_dir)
    problem = oracle_check.compare(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name])
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
