"""Every query against its SQL oracle on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql
from suite.queries import QUERIES
from suite.run_all import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_oracle(spark, name):
    assert name in oracle_sql()
    result = compare(spark, name, SF)
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry(spark).count() == 50
