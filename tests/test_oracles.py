"""Every query against its SQL, on the smallest table on which the item grid is full."""

import pytest
from conftest import comparable

from ablatrix.oracles import ORACLES
from ablatrix.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), oracle(DATA, ORACLES[name])
    assert comparable(found) == comparable(wanted)
