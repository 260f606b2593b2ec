"""Every named query against its SQL on the smallest data."""

import pytest
from oracle import compare

from lociframe.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    compare(spark, name)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
