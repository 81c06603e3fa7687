"""Every query of the catalogue runs, and agrees with its SQL text, on the smallest tables."""

import os

import pytest

from brindle.plans import catalogue
from tests.oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    if name in catalogue.ORACLE_SQL:
        assert differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_sql_texts_belong_to_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
