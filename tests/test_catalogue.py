import os

import pytest

import __spark_entry__ as entry
from catalogue import common
from catalogue.compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(common.QUERIES))
def test_query_matches_its_statement(spark, name):
    ok, note, _ = compare(spark, SF, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 10
