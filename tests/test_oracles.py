"""Every query with SQL gives the rows of its SQL on the smallest tables; the others give some."""

import pytest
from compare import connect, differences

from reelspark.plans import catalogue


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    frame = catalogue.QUERIES[name](spark, small)
    if name in catalogue.ORACLES:
        assert not differences(frame, con, catalogue.ORACLES[name])
    else:
        assert frame.count() > 0
