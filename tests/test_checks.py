"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import checks
from checks.compare import check, duck
from checks.registry import ORACLE, QUERIES

checks.load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("driver tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = check(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, note
