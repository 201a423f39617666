"""Every catalogue query against its DuckDB oracle SQL (small scale factor)."""

import os

import pytest

from labelforge.plans import check
from labelforge.plans.catalog import ORACLE, QUERIES

SF = os.environ.get("LABELFORGE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(f"{SF}/documents.parquet"):
        pytest.skip("test data not available")
    return check.duck(SF)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = check.compare(spark, SF, name, con)
    assert res["status"] == "match", res
