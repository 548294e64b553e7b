"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry
from check import compare, connect
from rankflow.workload.oracle import ORACLE
from rankflow.workload.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    assert compare(got, con.sql(ORACLE[name]).to_arrow_table()) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
