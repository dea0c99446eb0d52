"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry
from docfields.queries.registry import ORACLE, QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ours, theirs, left, right, _ = difference(spark, duck, QUERIES[name], ORACLE[name], SF_DIR)
    assert ours == theirs > 0 and not left and not right


def test_entry(spark):
    assert entry(spark).columns == ["key", "text", "total"]
