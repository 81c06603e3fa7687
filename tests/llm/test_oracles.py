"""Queries of the subpackage against their SQL texts, on the smallest tables."""

import os

import pytest

from brindle.llm import catalogue
from tests.oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, name):
    assert differences(spark, connect(SF), catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""
