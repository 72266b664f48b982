"""Every catalogued query against its SQL oracle on the smallest tables."""

import pytest

from catalog.all import ORACLES, QUERIES
from catalog.compare import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
#: What no row of the smallest tables meets; other tables have rows.
EMPTY = ("nearest_station_in_reach",)


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    problem = compare(spark, connection, FOLDER, name)
    assert problem == ("no rows" if name in EMPTY else "")
